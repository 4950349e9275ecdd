"""Personal data by weak supervision, with DataFrame functions only.

1. One pass over the texts finds base spans (fixed patterns and checks) and further candidates: look-alikes that fail a
   check, spelled-out e-mail addresses, addresses with "[.]" for their dots, card numbers with other separators, telephone
   numbers without a country code or with 00 for the plus. Five labelers vote on each candidate (for, abstain, against): the
   pattern, its check, a gazetteer, the words before it, and its shape. The gazetteer is a table (kind, entry, listed) of
   endings of host names, prefixes of networks, issuers and dialling codes, which travels as a literal map of at most
   ``GAZETTEER_ROWS`` rows and can be replaced by the caller's own.
2. Expectation maximisation over the counts of vote patterns estimates, for each kind, how votes go with the truth. There
   are at most 3^5 patterns of a kind, so only that many counts are gathered, however large the corpus is.
3. A naive Bayes span classifier learns from all candidates, weighted by the posteriors of their votes, over hashed
   features (votes, shape, neighbouring word), and decides on the candidates that the base patterns do not have.

Base spans always stay; the classifier only adds spans that overlap none of them and do not fail their kind's check.

Edge cases: a null or empty text has no spans; without candidates the model is empty and adds nothing; repeated rows are
judged one by one; other columns are not looked at. Offsets are code points.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import find_spans, literal_doubles, materialize, span_list

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, with what makes them linear: possessive runs, and no start inside a run that has failed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates.
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{1,63}+)++"
DEFANGED_IP = r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9])"
SPACED_CARD = r"(?<![0-9./-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./-])"
LONG_PHONE = r"(?<![0-9+.,-])00[1-9][0-9]{0,2}[\x20./-][\x20().0-9/-]{5,16}[0-9](?![0-9.,-])"
LOCAL_PHONE = r"(?<![0-9+.,-])\(?0?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.,-])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
# Gazetteer entries that speak for a kind, and against it. Host names go by their endings, the rest by prefixes.
LISTED = {
    "email": "com org net edu gov mil int info biz io eu de fr es uk it nl ch at us ca au pl pt se no dk fi ie be br mx jp cn in ru gmail.com googlemail.com outlook.com hotmail.com live.com msn.com yahoo.com icloud.com me.com aol.com gmx.de gmx.net web.de t-online.de orange.fr free.fr laposte.net proton.me protonmail.com mail.com yandex.ru qq.com 163.com",
    "ip": "8. 9. 10. 23. 52. 54. 104. 142. 172. 185. 192.168. 203. 212. 216.",
    "card": "4 51 52 53 54 55 22 23 24 25 26 27 34 37 36 38 6011 65 62",
    "phone": "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 358 359 370 371 372 380 385 386 420 421 852 886 971 972",
}
AGAINST_LISTED = {"email": "local localhost invalid png jpg gif", "ip": "0. 127. 224. 239. 240. 255.", "card": "0", "phone": "0"}
#: Rows of a gazetteer that travels with the plan, at most.
GAZETTEER_ROWS = 100_000
CUES = {
    "email": ["email", "e-mail", "mail", "contact", "contacto", "kontakt", "write", "courriel", "correo"],
    "ip": ["ip", "host", "server", "address", "adresse", "from", "client"],
    "card": ["card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono", "móvil"],
}
AGAINST = ["version", "isbn", "issn", "order", "invoice", "page", "section", "figure", "serial", "part", "no.", "nr."]
LABELERS = ["pattern", "check", "gazetteer", "context", "shape"]
#: Hash buckets of the span classifier, EM rounds, and the probability from which a candidate is added.
BUCKETS = 4_096
ROUNDS = 25
ACCEPT = 0.95


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    def doubled(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda c: c != ""), doubled)
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def passes(kind: str, text: Column) -> Column:
    """The check that a base match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(OCTETS)
    n = F.char_length(digits(text))
    if kind == "phone":
        return n.between(9, 15)
    return F.when(n.between(13, 19), luhn(digits(text))).otherwise(F.lit(False))


def _vote(is_for: Column, is_against: Column | None = None) -> Column:
    """2 for, 1 abstain, 0 against."""
    out = F.when(is_for, 2)
    return (out if is_against is None else out.when(is_against, 0)).otherwise(1)


def gazetteer_rows() -> list[tuple[str, str, bool]]:
    """(kind, entry, listed): what the module knows by itself."""
    return [(kind, x, good) for table, good in ((LISTED, True), (AGAINST_LISTED, False)) for kind, entries in table.items() for x in entries.split()]


def _known(kind: str, text: Column, gazetteer: Column) -> tuple[Column, Column]:
    """Whether the gazetteer lists the candidate, and whether it lists it as something else; the longest entry decides."""
    if kind == "email":
        host = F.regexp_replace(F.lower(F.regexp_extract(text, r"(?:@|\(at\)|\[at\]|\{at\})\x20?(.*)$", 1)), r"\x20?(?:\(dot\)|\[dot\]|\.)\x20?", ".")
        parts = F.split(host, r"\.")
        names = F.array(*[F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".") for n in (2, 1)])
    else:
        plain = F.regexp_replace(text, r"[\[\]()]", "") if kind == "ip" else F.regexp_replace(digits(text), "^00", "") if kind == "phone" else digits(text)
        if kind == "ip":
            octets = F.split(plain, r"\.")
            names = F.array(F.concat(F.array_join(F.slice(octets, 1, 2), "."), F.lit(".")), F.concat(F.get(octets, F.lit(0)), F.lit(".")))
        else:
            names = F.array(*[F.substring(plain, 1, n) for n in (4, 3, 2, 1)])
    found = F.get(F.filter(F.transform(names, lambda x: F.element_at(gazetteer, F.concat(F.lit(f"{kind}:"), x))), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(found, F.lit(False)), F.coalesce(~found, F.lit(False))


def _votes(kind: str, text: Column, lead: Column, before: Column, matched: bool, gazetteer: Column) -> Column:
    n = F.char_length(digits(text))
    ok = passes(kind, F.regexp_replace(text, r"[\[\]()]", "") if kind == "ip" else text)
    known, odd = _known(kind, text, gazetteer)
    if kind == "email":
        even = text.rlike(r"^[A-Za-z0-9]")
    elif kind == "ip":
        even = ~text.rlike(r"(?:^|\.)0[0-9]")
    elif kind == "card":
        odd = odd | digits(text).rlike(r"^([0-9])\1+$")
        even = text.rlike(r"^(?:[0-9]+|(?:[0-9]{4}[\x20-]){3}[0-9]{1,7}|(?:[0-9]{4}[./_]){3}[0-9]{4})$")
    else:
        inland = text.rlike(r"^\(?0[1-9]")  # a number without a country code cannot be listed by one
        known, odd = known & (text.startswith("+") | text.startswith("00")), odd & ~inland | (~text.startswith("+") & ~text.rlike(r"^\(?0"))
        even = text.rlike(r"^(?:\+|00)?[0-9]{0,3}[\x20.-]?\(?[0-9]{1,5}\)?(?:[\x20.-]?[0-9]{2,5})+$")
    cue = F.arrays_overlap(F.array(*map(F.lit, CUES[kind])), F.split(lead, r"[\x20\x09-\x0D:=#(,;]+"))
    return F.array(
        _vote(F.lit(matched) & ok, F.lit(matched) & ~ok), _vote(ok if matched or kind != "email" else F.lit(False), ~ok | (n == 0) if kind != "email" else None),
        _vote(known, odd), _vote(cue, before.isin(AGAINST)), _vote(even, ~even))


CANDIDATE = "struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,features:array<int>>"


def _candidates(text: Column, kind: str, pattern: str, matched: bool, gazetteer: Column) -> Column:
    spans = find_spans(text, pattern)
    if matched and kind == "card":  # short numbers are no look-alikes
        spans = F.filter(spans, lambda s: F.char_length(digits(s["text"])) >= 8)

    def full(s: Column) -> Column:
        lead = F.lower(F.substring(text, F.greatest(s["start"] - 24, F.lit(0)) + 1, F.least(s["start"], F.lit(24))))
        before = F.regexp_extract(lead, r"([^\x20\x09-\x0D:=#(]+)[\x20\x09-\x0D:=#(]*$", 1)
        votes = _votes(kind, s["text"], lead, before, matched, gazetteer)
        shape = F.substring(F.regexp_replace(F.regexp_replace(s["text"], "[0-9]", "9"), "[A-Za-z]+", "a"), 1, 32)
        named = [F.concat(F.lit(f"{n}={kind}="), votes[i].cast("string")) for i, n in enumerate(LABELERS)]
        named += [F.concat(F.lit(f"shape={kind}="), shape), F.concat(F.lit(f"before={kind}="), before)]
        features = F.array(*[F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int") for x in named])
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (F.lit(matched) & passes(kind, s["text"])).alias("base"), votes.alias("votes"), features.alias("features"))

    return F.transform(spans, full)


def _gazetteer(table: DataFrame | None) -> Column:
    """map of "kind:entry" to whether it speaks for the kind."""
    rows = gazetteer_rows() if table is None else [tuple(r) for r in table.select("kind", "entry", "listed").limit(GAZETTEER_ROWS + 1).collect()]
    if len(rows) > GAZETTEER_ROWS:
        raise ValueError(f"a gazetteer has at most {GAZETTEER_ROWS} rows")
    return F.from_json(F.lit(json.dumps({f"{kind}:{entry}": listed for kind, entry, listed in rows})), "map<string,boolean>")


def candidates(docs: DataFrame, *, gazetteer: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found), a row for each row of ``docs``: base spans and other candidates with votes and features."""
    none = F.array().cast(f"array<{CANDIDATE}>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text, known = F.col("text"), _gazetteer(gazetteer)
    # cheap tests first: most texts have neither digits nor signs
    tests = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]")}
    parts = [F.when(tests[k], _candidates(text, k, PATTERNS[k], True, known)).otherwise(none) for k in KINDS]
    more = [("email", SPELLED_EMAIL, text.rlike(r"[(\[{]at[)\]}]")), ("ip", DEFANGED_IP, text.rlike(r"[0-9][\[(]\.")), ("card", SPACED_CARD, text.rlike(r"[0-9]{4}[./_][0-9]{4}[./_]")), ("phone", LONG_PHONE, F.contains(text, F.lit("00"))), ("phone", LOCAL_PHONE, tests["card"])]
    parts += [F.when(test, _candidates(text, kind, pattern, False, known)).otherwise(none) for kind, pattern, test in more]
    return rows.select("doc_id", F.concat(*parts).alias("found"))


def reliabilities(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation maximisation over counts of (kind, votes): the posterior that such a candidate is personal data.

    For each kind, a prior and, for each labeler and truth, the shares of its three votes; starts from the votes' majority.
    """
    post = {}
    for (kind, votes) in counts:
        lean = sum(v - 1 for v in votes)
        post[kind, votes] = min(max(0.5 + 0.2 * lean, 0.05), 0.95)
    for _ in range(rounds if counts else 0):
        size, share = defaultdict(lambda: [1.0, 1.0]), defaultdict(lambda: 0.5)
        for (kind, votes), n in counts.items():
            p = post[kind, votes]
            for truth, w in ((1, n * p), (0, n * (1 - p))):
                size[kind][truth] += w
                for i, v in enumerate(votes):
                    share[kind, i, truth, v] += w
        for kind, votes in post:
            odds = math.log(size[kind][1] / size[kind][0])
            for i, v in enumerate(votes):
                odds += math.log(share[kind, i, 1, v] / (size[kind][1] + 0.5)) - math.log(share[kind, i, 0, v] / (size[kind][0] + 0.5))
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post


def train(found: DataFrame) -> list[float]:
    """Log odds of the span classifier: BUCKETS feature weights and, last, the bias."""
    each = found.select(F.explode("found").alias("c")).select("c.*")
    counts = {(r["kind"], tuple(r["votes"])): r["count"] for r in each.groupBy("kind", "votes").count().toLocalIterator()}  # 4 * 3^5 at most
    post = reliabilities(counts)
    if not post:
        return [0.0] * BUCKETS + [-100.0]
    key = F.concat_ws("|", "kind", F.concat_ws("", F.col("votes").cast("array<string>")))
    table = F.from_json(F.lit(json.dumps({f"{k}|{''.join(map(str, v))}": p for (k, v), p in post.items()})), "map<string,double>")
    weighed = each.withColumn("p", F.element_at(table, key))
    total = weighed.agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).first()
    yes, no = total["yes"] + 1, total["no"] + 1
    weights = [0.0] * BUCKETS
    for r in weighed.select("p", F.explode("features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).toLocalIterator():
        weights[r["f"]] = math.log((r["yes"] + 0.5) / (yes + 0.5)) - math.log((r["no"] + 0.5) / (no + 0.5))
    return [*weights, math.log(yes / no)]


def personal_data(docs: DataFrame, *, accept: float = ACCEPT, gazetteer: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) for each row of ``docs``."""
    found = materialize(candidates(docs, gazetteer=gazetteer, id_col=id_col, text_col=text_col), "pii-candidates")
    weights = train(found)
    model = literal_doubles(weights)
    slim = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.transform(F.filter("found", lambda s: s["base"]), slim)
    odds = lambda s: F.aggregate(s["features"], F.lit(weights[-1]), lambda a, f: a + F.get(model, f))
    liked = F.filter("found", lambda s: ~s["base"] & (F.get(s["votes"], F.lit(LABELERS.index("check"))) > 0) & (odds(s) >= math.log(accept / (1 - accept))))
    rows = found.select("doc_id", base.alias("base"), F.transform(liked, slim).alias("liked"))
    free = F.filter("liked", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    first = F.array_sort(F.transform(F.array_distinct(free), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(s: Column, x: Column) -> Column:
        added = F.concat(s["out"], F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end"))))
        return F.when(x["start"] < s["upto"], s).otherwise(F.struct((-x["back"]).alias("upto"), added.alias("out")))

    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("out"))
    return rows.select("doc_id", "base", F.aggregate(first, start, step, lambda s: s["out"]).alias("added"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The counts, the digest of the base spans and the list of all spans."""
    return found.select("doc_id", *map(_count, KINDS), F.sha2(span_list(F.col("base"), KINDS, True).cast("binary"), 256).alias("base_sha256"), span_list(F.concat("base", "added"), KINDS, True).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
