"""Small tables with everything an operator may meet, and plain versions of the operators."""

from __future__ import annotations

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "Text", "kept", "_row", "id", "n"]
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, b string, c string,"
    " d string, e string, f string"
)


def text_rows() -> list[tuple]:
    """(doc_id, text): NULL, empty, blank, one word, very long, equal, near and repeated ones."""
    rng = random.Random(7)
    pool = [f"{a}{b}" for a in ("ra", "lo", "Mi", "té") for b in ("ne", "st,", "x.", "ou")]
    prose = [" ".join(rng.choice(pool) for _ in range(n)) for n in (60, 90, 200, 70)]
    changed = prose[2].split()
    changed[100] = "other"
    long = " ".join(f"{rng.choice(pool)}{rng.randrange(900)}" for _ in range(20_000))
    mail = "write to jo.doe@mail.example.org or +1 (234) 567-8901, card 4111 1111 1111 1111 from"
    texts = [
        None,
        "",
        " \n\t ",
        "one",
        "two words\nand\nand\nand\n",
        *prose,
        prose[0],
        prose[0].replace(" ", "\t\n", 3),
        " ".join(changed),
        prose[1] + "\n" + prose[3],
        "intro " + prose[3] + " end",
        long,
        long + " end",
        f"{mail} 10.0.0.255 and 1.2.3.400",
        f"{mail} 10.0.0.255 again",
        f"{mail} 10.0.0.255 thrice",
        "word " * 300,
        "\x1c<|endoftext|> It's \x85ß İstanbul é 日本語 \U0001f600 " * 3,
    ]
    return list(enumerate(texts))


def docs(spark, rows):
    """Rows as a table of documents with further columns whose names clash."""
    full = [
        (i, t, (None, "en", "xx")[k % 3], (None, "s0", "s0", "s1")[k % 4], len(t or ""), "x", "no",
         "7", "i", "1")
        for k, (i, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3).toDF(*NAMES)


def dirty_rows() -> list[tuple]:
    """Repeated rows, repeated ids and missing ids."""
    rows = text_rows()
    return rows + [rows[5], rows[5], (6, "another text of id six"), (None, rows[7][1]), (None, None)]


def words(text):
    return WORD.findall(text or "")


def repeats_removed(rows, window=35):
    """(n_words, n_removed, kept words) per row."""
    all_words = [words(t) for _, t in rows]
    seen = collections.Counter(
        tuple(w[j : j + window]) for w in all_words for j in range(len(w) - window + 1)
    )
    out = []
    for w in all_words:
        covered = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] > 1:
                covered[j : j + window] = [True] * window
        kept = [x for x, c in zip(w, covered, strict=True) if not c]
        out.append((len(w), sum(covered), " ".join(kept)))
    return out


def rule_counts(text):
    w = words(text)
    seen, doubles = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            doubles += line in seen
            seen.add(line)
    threes = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {
        i + k for i in range(len(w) - 2) if threes[tuple(w[i : i + 3])] > 1 for k in range(3)
    }
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": doubles,
        "n_repeat_words": len(covered),
    }


def fingerprint(text):
    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lower)
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    """Smallest member of each node's component."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    """Base spans: (start, place of the kind, kind, end)."""
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)
