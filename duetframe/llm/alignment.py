"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte, and how often two ids end together.

A text is encoded once by both tokenizers, in slices of an Arrow batch; words that come again are not encoded again, where
both tokenizers keep a word and the spaces before it apart from what precedes. Their end offsets are two rising lists over the same
bytes. The shorter list of a text drives: each of its ends gallops into the longer one, in steps that double until it is
passed, and a binary search ends it. The common ends cut both token lists into groups, and differences of their ranks say
how many tokens of each a group has. All of that is a map over the texts, so no group of rows meets in a task.

Ids that end together are counted in each task before the shuffle. Of two such tokens the shorter one's bytes end the longer
one's, so there are no more pairs than the entries of both vocabularies have bytes (about half a million): that bounds the
counts of a task, the driver's table, and what goes back to the workers.

Edge cases: a text that is null, empty, no valid UTF-8, or that one of the tokenizers does not give back byte for byte (one
with U+2581, say) has no tokens; repeated rows are aligned and counted one by one; very long texts are one slice each, and
cost what their tokens cost; a table without rows gives none; other columns are not looked at, ``row`` carries what is asked.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Folder of the vocabulary files, and the two that the registered query aligns.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Fixed value: how a byte-level BPE with its own pattern cuts a text before anything merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text, and of links, that a slice of a batch holds at most (or one text).
SLICE_BYTES, SLICE_LINKS = 1 << 18, 1 << 19

ALIGNED = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: A word with the spaces before it; texts that cannot be cut into such words without changing their tokens: white space
#: before a space (a run of it may be one token), or a space at the end.
WORD, WHOLE = re.compile(" +[^ ]+"), re.compile(r"[^\S ] | \Z")


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    return np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))


class ByteLevel:
    """A byte-level BPE in the JSON format of ``tokenizers``; special tokens in a text are ordinary text."""

    #: Characters of a word that is encoded together with others.
    SHORT = 64

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            setup = json.load(f)
        self.path, byte = path, byte_level()
        vocabulary = setup["model"]["vocab"] | {x["content"]: x["id"] for x in setup["added_tokens"]}
        self.table = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.table[i] = bytes(map(byte.get, entry)) if all(map(byte.__contains__, entry)) else entry.encode()
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        before, merges = setup["pre_tokenizer"] or {}, setup["model"].get("merges", [])
        # words are split off before anything merges: a space never follows another character in a token
        self.by_word = setup["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        own = {self.table[i]: i for i in range(len(self.table)) if i not in {x["id"] for x in setup["added_tokens"]}}
        self.ranked = None
        if self.by_word and len(own) == 256 + len(made) and all(x < y for x, y in itertools.pairwise(made)):
            import tiktoken

            # the same merges by rank, as ids rise in their order, in the library that is quicker on words
            self.ranked = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})

    @functools.cached_property
    def model(self):
        """The tokenizer itself, for texts that are no short words."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has) of texts that begin with a space.

        Short words are encoded as one text, and their tokens told apart by their bytes.
        """
        single = np.array([len(t) <= self.SHORT and WORD.fullmatch(t) is not None and not t[-1].isspace() for t in texts], bool) if self.ranked else np.zeros(len(texts), bool)
        words = list(itertools.compress(texts, single))
        ids = np.array(self.ranked.encode_ordinary("".join(words)) if words else [], np.int32)
        ends, stops = np.cumsum(self.lengths[ids]), np.cumsum([len(w.encode()) for w in words])
        at = np.searchsorted(ends, stops)
        if len(words) and (at[-1] + 1 != len(ids) or (ends[at] != stops).any()):
            return self._each(texts)
        rest, n_rest = self._each(list(itertools.compress(texts, ~single)))
        sizes = np.zeros(len(texts), np.int64)
        sizes[single], sizes[~single] = np.diff(at, prepend=-1), n_rest
        out = np.empty(len(ids) + len(rest), np.int32)
        mine = np.repeat(single, sizes)
        out[mine], out[~mine] = ids, rest
        return out, sizes

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)] if texts else [])


class Pieces:
    """A sentencepiece model, which puts the leading space there itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_word = not any("\u2581" in p.lstrip("\u2581") for p in pieces)
        self.table = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.table], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has) of texts that begin with a space."""
        return _flat(self.model.encode([t[1:] for t in texts], num_threads=1))


def load(path: str) -> ByteLevel | Pieces:
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class Encoder:
    """Ids of words, kept as bytes from one slice to the next; so many words and characters of a word at most."""

    KEPT, LONGEST = 60_000, 64

    def __init__(self, tokenizer: ByteLevel | Pieces) -> None:
        self.tokenizer, self.lengths = tokenizer, tokenizer.lengths
        self.kept: dict[str, bytes] = {}  # empty: the tokens' bytes are not the word's

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, how many each has, whether its tokens' bytes are its own)."""
        missing = [w for w in words if w not in self.kept]
        fresh: dict[str, bytes] = {}
        if missing:
            ids, sizes = self.tokenizer.encode(missing)
            table, raw, stop = self.tokenizer.table, ids.tobytes(), np.cumsum(sizes).tolist()
            fresh = {w: raw[4 * i:4 * j] for w, i, j in zip(missing, [0, *stop], stop, strict=False)}
            total = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            own = np.diff(total[np.concatenate([[0], stop])]) == [len(w.encode()) for w in missing]
            if not own.all() or b"".join([table[i] for i in ids.tolist()]) != "".join(missing).encode():
                fresh = {w: x if b"".join([table[i] for i in np.frombuffer(x, np.int32).tolist()]) == w.encode() else b"" for w, x in fresh.items()}
        got = [fresh[w] if w in fresh else self.kept[w] for w in words]
        if len(self.kept) > self.KEPT:
            self.kept.clear()
        self.kept.update((w, x) for w, x in fresh.items() if len(w) <= self.LONGEST)
        sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return np.frombuffer(b"".join(got), np.int32), sizes, sizes > 0


def gallop(keys: np.ndarray, into: np.ndarray, start: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """For each key the first place in ``into[first:last]`` (rising) whose value is not below it.

    From ``start`` the search goes towards the key in steps of 1, 2, 4 ... until it has passed it, then halves what lies
    between. All keys step side by side; those that have passed theirs drop out.
    """
    low, high = first.copy(), last.copy()  # the answer lies in [low, high]
    at = np.clip(start, first, last)
    below = np.zeros(len(keys), bool)
    there = at < last
    below[there] = into[at[there]] < keys[there]
    low[below] = at[below] + 1
    high[~below] = at[~below]
    for up in (True, False):
        todo, step = np.flatnonzero(below == up), 1
        while len(todo):
            probe = at[todo] + step if up else at[todo] - step
            inside = (probe < high[todo]) if up else (probe >= low[todo])
            todo, probe = todo[inside], probe[inside]
            less = into[probe] < keys[todo]
            low[todo[less]] = probe[less] + 1
            high[todo[~less]] = probe[~less]
            todo = todo[less] if up else todo[~less]
            step *= 2
    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = (low[todo] + high[todo]) >> 1
        less = into[mid] < keys[todo]
        low[todo[less]] = mid[less] + 1
        high[todo[~less]] = mid[~less]
        todo = todo[low[todo] < high[todo]]
    return low


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_off: np.ndarray, b_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of equal ends in ``a_ends`` and ``b_ends``, for texts side by side whose lists begin at the offsets."""
    n_a, n_b = np.diff(a_off), np.diff(b_off)
    found_a, found_b = [], []
    for short, long, s_off, l_off, texts, out_s, out_l in ((a_ends, b_ends, a_off, b_off, n_a <= n_b, found_a, found_b), (b_ends, a_ends, b_off, a_off, n_a > n_b, found_b, found_a)):
        n_s, n_l = np.diff(s_off), np.diff(l_off)
        text = np.repeat(np.flatnonzero(texts), n_s[texts])
        rank = np.arange(len(text)) - np.repeat(np.cumsum(n_s[texts]) - n_s[texts], n_s[texts])
        i = s_off[text] + rank
        keys, first, last = short[i], l_off[text], l_off[text + 1]
        at = gallop(keys, long, first + rank * n_l[text] // np.maximum(n_s[text], 1), first, last)
        hit = at < last
        hit[hit] = long[at[hit]] == keys[hit]
        out_s.append(i[hit])
        out_l.append(at[hit])
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _repeated(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that ``which`` names, one after the other; run i has ``sizes[i]`` elements."""
    n, start = sizes[which], np.cumsum(sizes) - sizes
    return flat[np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def _texts(column: pa.Array) -> list[str | None]:
    """The texts of a column, None for those that have no tokens."""
    out = []
    for x in column.cast(pa.binary()).to_pylist():
        try:
            out.append(f" {x.decode()}" if x else None)
        except UnicodeDecodeError:
            out.append(None)
    return out


class Aligner:
    """Both tokenizers of a task."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.both = [Encoder(load(path_a)), Encoder(load(path_b))]
        self.by_word = all(e.tokenizer.by_word for e in self.both)

    def __call__(self, column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids of A and B, how many each text has, how many each group has, how many groups each text has)."""
        texts = _texts(column)
        words = [() if t is None else WORD.findall(t) if self.by_word and not WHOLE.search(t) else (t,) for t in texts]
        place: dict[str, int] = {}
        which = np.array([place.setdefault(w, len(place)) for text in words for w in text], np.int64)
        text_of = np.repeat(np.arange(len(words)), [len(x) for x in words])
        got = [e(list(place)) for e in self.both]
        bad = np.zeros(len(words), bool)
        bad[text_of[~(got[0][2] & got[1][2])[which]]] = True
        which, text_of = which[~bad[text_of]], text_of[~bad[text_of]]
        flat = [_repeated(ids, sizes, which) for ids, sizes, _ in got]
        counts = [np.bincount(text_of, sizes[which], len(words)).astype(np.int64) for _, sizes, _ in got]
        ends = [np.cumsum(e.lengths[ids]) for e, ids in zip(self.both, flat, strict=True)]
        at_a, at_b = common_ends(*ends, *(np.concatenate([[0], np.cumsum(n)]) for n in counts))
        groups = np.bincount(np.searchsorted(np.cumsum(counts[0]), at_a, "right"), minlength=len(words))
        # every text's last tokens end together, so ranks of the text before it are where the next one's begin
        return flat, counts, [np.diff(np.concatenate([[-1], at])) for at in (at_a, at_b)], groups


def align(docs: DataFrame, path_a: str = f"{TOKENIZERS}/{BYTE_BPE}", path_b: str = f"{TOKENIZERS}/{PIECE_BPE}", *, row: Column | None = None, text_col: str = "text") -> DataFrame:
    """(row, a_ids, b_ids, a_sizes, b_sizes) of each row: the tokens of both tokenizers, and how many of each every group has.

    ``row`` is what to carry along, all columns by default. The files must be there on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, batch.column(1), SLICE_BYTES):
                (a, b), (n_a, n_b), (size_a, size_b), groups = aligner(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(a, n_a), _lists(b, n_b), _lists(size_a, groups), _lists(size_b, groups)], ["row", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    rows = docs.select((F.struct("*") if row is None else row).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {ALIGNED}")


LINKED = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def linked(docs: DataFrame, path_a: str = f"{TOKENIZERS}/{BYTE_BPE}", path_b: str = f"{TOKENIZERS}/{PIECE_BPE}", *, row: Column | None = None, text_col: str = "text") -> DataFrame:
    """(row, n_a, n_b, n_groups, groups_sha256, links) of each row: what counting over all texts needs of ``align``.

    The digest is of the groups as ``a1,a2|b1;a3|b2``, empty for a text without tokens. ``links`` has the pair of ids that
    ends each group, a whole number of 4 bytes (or 8, if the vocabularies need it): the id of A shifted by the bits of those
    of B, plus the id of B.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        size_of = [len(e.tokenizer.table) for e in aligner.both]
        shift = (size_of[1] - 1).bit_length()
        kind = "<u4" if (size_of[0] - 1).bit_length() + shift <= 32 else "<u8"
        # decimal ids, each with what may follow it: another of its group, or the end of the group's part
        names = np.array([f"{i}{end}" for size, mark in zip(size_of, "|;", strict=True) for i in range(size) for end in (",", mark)], object)
        for batch in batches:
            for part in slices(batch, batch.column(1), SLICE_BYTES):
                (a, b), (n_a, n_b), (size_a, size_b), groups = aligner(part.column(1))
                end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
                last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                last_a[end_a - 1], last_b[end_b - 1] = 1, 1
                order = np.empty(len(a) + len(b), np.int64)  # a group's tokens of A, then those of B
                order[np.arange(len(a)) + np.repeat(end_b - size_b, size_a)] = 2 * a.astype(np.int64) + last_a
                order[np.arange(len(b)) + np.repeat(end_a, size_b)] = 2 * size_of[0] + 2 * b.astype(np.int64) + last_b
                until = np.cumsum(n_a + n_b)
                digests = [hashlib.sha256("".join(names[order[e - n:e]])[:-1].encode()).hexdigest() if n else "" for e, n in zip(until.tolist(), (n_a + n_b).tolist(), strict=True)]
                links = (a[end_a - 1].astype(np.int64) << shift | b[end_b - 1]).astype(kind)
                stops = np.cumsum(groups)
                each = [links[e - n:e].tobytes() for e, n in zip(stops.tolist(), groups.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n_a, n_b, groups)), pa.array(digests, pa.string()), pa.array(each, pa.binary())], ["row", *(x.split()[0] for x in LINKED.split(", "))])

    rows = docs.select((F.struct("*") if row is None else row).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {LINKED}")


def _links(column: pa.Array, groups: np.ndarray) -> np.ndarray:
    """The links of a slice's texts, one after the other; a link has 4 or 8 bytes."""
    raw = b"".join(column.cast(pa.binary()).to_pylist())
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * groups.sum() else "<u8").astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, batch.column(1), SLICE_LINKS):
            here, times = np.unique(_links(part.column(1), part.column(0).to_numpy()), return_counts=True)
            codes, at = np.unique(np.concatenate([codes, here]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times]), len(codes)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["link", "n"])


def pair_counts(found: DataFrame, path_b: str = f"{TOKENIZERS}/{PIECE_BPE}") -> DataFrame:
    """(a_id, b_id, n, best, link) out of ``linked``: how many groups of all texts the two ids end, and whether no other
    ``a_id`` ends more with ``b_id``."""
    shift = (len(load(path_b).table) - 1).bit_length()
    pairs = found.select("n_groups", "links").mapInArrow(_count, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))
    pairs = pairs.select(F.shiftright("link", shift).cast("int").alias("a_id"), F.col("link").bitwiseAND(F.lit((1 << shift) - 1)).cast("int").alias("b_id"), "n", "link")
    top = pairs.groupBy("b_id").agg(F.max("n").alias("top"))
    return pairs.join(top, "b_id").select("a_id", "b_id", "n", (F.col("n") == F.col("top")).alias("best"), "link")


FIGURES = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def figures(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``linked``.

    ``pairs`` are its ``pair_counts``, which the vocabularies bound. Tokens that end a group are linked; each has bytes, so
    a group is one link.
    """
    got = pairs.select("link", "n", "best").toArrow()
    columns = [got.column(k).to_numpy() for k in ("link", "n", "best")]
    order = np.argsort(columns[0])
    known = found.sparkSession.sparkContext.broadcast(tuple(c[order] for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times, best = known.value
        for batch in batches:
            for part in slices(batch, batch.column(5), SLICE_LINKS):
                groups = part.column(3).to_numpy()
                at, end = np.searchsorted(codes, _links(part.column(5), groups)), np.cumsum(groups)
                n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(v[at])])[np.concatenate([[0], end])]) for v in (best.astype(np.int64), times))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], part.column(3), pa.array(n_best), pa.array(count_sum), part.column(4)], ["row", *(x.split()[0] for x in FIGURES.split(", "))])

    return found.select("row", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(run, f"row {found.schema['row'].dataType.simpleString()}, {FIGURES}")


def id_map(pairs: DataFrame) -> DataFrame:
    """(b_id, a_id, n, share): for each id of B the id of A that ends most groups with it (the smallest of equals), and of how many."""
    return pairs.groupBy("b_id").agg(F.max_by("a_id", F.struct("n", -F.col("a_id"))).alias("a_id"), F.max("n").alias("n"), (F.max("n") / F.sum("n")).alias("share"))
