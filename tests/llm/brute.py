"""The contracts in plain Python, without any of the operators' methods."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {65 + i: 97 + i for i in range(26)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs):
    fps = {}
    for d, t in docs:
        w = WORDS.findall((t or "").translate(LOW))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
    ids, parent = sorted(fps), {d: d for d in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (f"{fps[d]:016x}", root(d)) for d in ids}


def op4(docs, width=50):
    first = {}
    split = {d: WORDS.findall(t or "") for d, t in docs}
    for d, w in split.items():
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in split.items():
        gone = {i + j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(width)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def op5(docs, chars=40, least=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (len(k := key(x)) >= chars and len(held[k]) >= least and max(held[k]) != d)]
        out[d] = (len(ls), len(ls) - len(kept), sha("\n".join(kept)))
    return out


def op6(text):
    text = text or ""
    w = WORDS.findall(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + j for i, t in enumerate(tri) if n[t] > 1 for j in range(3)}
    ls = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


FORMS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op9(text):
    out = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            right = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if right:
                out.append((m.start(), k, m.end()))
    out.sort()
    counts = Counter(FORMS[k][0] for _, k, _ in out)
    joined = ",".join(f"{FORMS[k][0]}:{a}:{b}" for a, k, b in out)
    return (*[counts[k] for k, _ in FORMS], sha(joined), joined)


def op10(docs, path, size=2048):
    from tokenizers import Tokenizer

    t, out = Tokenizer.from_file(path), {}
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), size):
            cut = ids[k : k + size]
            out[d, k // size] = (k, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut)))
    return out
