"""Plain Python versions of the operators' results, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WS = re.compile("[^\x20\x09-\x0d]+")


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text):
    return WS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii(text):
    """The base spans: (kind, start, end) by kind, then start."""
    text, out = text or "", []
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 13 <= len(n := re.sub("[^0-9]", "", m)) <= 19 and luhn(n),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    for kind, pattern in patterns.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok[kind](m.group())]
    return out


def secrets(text):
    """The base spans: (kind, start, end) by start, then kind."""
    text, out = text or "", []
    for kind, pattern in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            n = len(m.group(2)) if kind == "assign" else len(m.group())
            if n >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def spans(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def fingerprint(text, k=4):
    w = ascii_lower(text or "")
    w = words(w)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, linked):
    """nodes: key to value; linked(a value, b value). Key to smallest key reachable."""
    parent = {k: k for k in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keys = sorted(nodes)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if linked(nodes[a], nodes[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def warc(pages):
    """page_id to (bytes, digest, type, refers_to); pages: page_id to html."""
    body = {p: (h or "").encode() for p, h in pages.items()}
    first = {}
    for p in sorted(body):
        first.setdefault(body[p], p)
    out = {}
    for p, b in body.items():
        again = len(b) >= 100 and first[b] != p
        out[p] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)
    return out


def dedup_lines(docs):
    """doc_id to (lines, dropped, kept text)."""
    key = lambda line: ascii_lower(line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    first = {}
    for d in sorted(docs):
        for line in (docs[d] or "").split("\n"):
            first.setdefault(key(line), d)
    out = {}
    for d, text in docs.items():
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == d]
        out[d] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def decontaminate(docs, items, window=10):
    """doc_id to (words, hit, sorted items); items: (item_id, text) or a dictionary."""
    wins = defaultdict(set)
    for item, text in items.items() if isinstance(items, dict) else items:
        w = item_words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[i:i + n])] |= {str(item)} - {"None"}
    lengths = {len(w) for w in wins}
    out = {}
    for d, text in docs.items():
        w, hit, found = item_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i:i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[x]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    runs = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)
