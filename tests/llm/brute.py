"""Plain single-process versions that the operators are held against."""

from __future__ import annotations

import hashlib


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), comparing all pairs that share a shingle."""
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split() if t else []
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    by: dict = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    seen = set()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a], sets[b]
                    both = len(x & y)
                    if 100 * both >= 80 * (len(x) + len(y) - both):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in texts}


def repeats(texts: dict[int, str | None], window: int = 20) -> dict[int, tuple[int, int, str]]:
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    seen, out = set(), {}
    for d in sorted(texts):
        w = texts[d].encode().split() if texts[d] else []
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def imatch(rows: list[tuple[int | None, str | None]], low: float, high: float) -> list[tuple]:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one term and subset at a time."""
    import xxhash

    def spread(x: int) -> int:
        m = (1 << 64) - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    rows = [(d, t or "") for d, t in rows]
    df: dict[bytes, int] = {}
    for _, t in rows:
        for w in set(t.encode().lower().split()):
            df[w] = df.get(w, 0) + 1
    band = {w for w, c in df.items() if max(2.0, low * len(rows)) <= c <= high * len(rows)}

    def prints(text: str) -> list[int] | None:
        terms = set(text.encode().lower().split())
        mine = sorted(terms & band) or sorted(terms)
        if not mine:
            return None
        h = [xxhash.xxh64_intdigest(w) for w in mine]
        out = [xxhash.xxh32_intdigest(b"".join(x.to_bytes(8, "little") for x in h)) | 1]
        for level in range(6):
            for subset in range(16):
                kept = [x for x in h if spread(x ^ spread(subset + 1)) % (1 << (2 * level + 1)) == 0]
                total = sum(map(spread, kept)) & ((1 << 64) - 1)
                out.append(spread(total) >> 32 | 1 if kept else 0)
        return out

    def alike(a, b) -> float:
        if a is None or b is None:
            return float(a is None and b is None)
        for level in range(5, -1, -1):
            x, y = a[1 + 16 * level : 17 + 16 * level], b[1 + 16 * level : 17 + 16 * level]
            filled = [(p, q) for p, q in zip(x, y) if p or q]
            if len(filled) >= 8:
                return sum(p == q for p, q in filled) / len(filled)
        return float(a[0] == b[0])

    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        p, e, n = prints(t), prints(edited), prints(after)
        text = lambda f: "-" if f is None else "".join(f"{x:08x}" for x in f)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(p), text(e), alike(p, e), alike(p, n)))
    return out


def class_scores(texts: dict[int, str | None], train: set[int], class_of: dict[bytes, int], bucket_class: list[int], width: int, backoff: float) -> dict[int, float]:
    """doc_id -> log10 probability under class bigrams, counted token by token; ``class_of`` has the words met twice or more."""
    import math
    import zlib
    from collections import Counter

    words = {d: (t or "").encode().lower().split() for d, t in texts.items()}
    count = Counter(w for d in train for w in words[d])
    end, bucket = width - 1, lambda w: zlib.crc32(w[-3:]) % len(bucket_class)
    cls = lambda w: class_of[w] if count[w] > 1 else bucket_class[bucket(w)]
    path = lambda ws: [end, *map(cls, ws), end]
    pairs = Counter(p for d in train for p in zip(path(words[d]), path(words[d])[1:]))
    once = Counter(bucket(w) for w, c in count.items() if c == 1)
    size = [sum(pairs[v, g] for v in range(width)) for g in range(width)]
    members = Counter([*class_of.values(), *bucket_class, end])
    total = sum(size) + width
    row = [sum(pairs[v, g] for g in range(width)) for v in range(width)]

    def step(v: int, g: int) -> float:
        return (pairs[v, g] + backoff * (size[g] + 1) / total) / (row[v] + backoff)

    def emit(w: bytes, g: int) -> float:
        mass = size[g] + members[g] / 2
        if count[w] > 1:
            return (count[w] + 0.5) / mass
        n = once[bucket(w)]
        return (n + 0.5) / mass * (count[w] + 1) / (2 * n + 1)

    out = {}
    for d, ws in words.items():
        p = path(ws)
        ends = (len(train) + 0.5) / (size[end] + 0.5)
        out[d] = sum(math.log10(step(v, g)) for v, g in zip(p, p[1:])) + sum(math.log10(emit(w, cls(w))) for w in ws) + math.log10(ends)
    return out


def statistics(text: str | None) -> dict[str, int]:
    """Word by word and character by character."""
    import re
    from collections import Counter

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for w in words for c in w), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again),
        "n_upper": sum("A" <= c <= "Z" for w in words for c in w), "n_marks": sum(c in "!?" for w in words for c in w), "n_digits": sum("0" <= c <= "9" for w in words for c in w), "n_distinct": len(set(words)),
        "n_lines": text.count("\n") + 1 if text else 0, "n_stops": sum(c in ".,;:" for w in words for c in w),
    }


def judged(texts: dict[int, str | None], rules: list) -> set[int]:
    """Ids of the texts that neither the base rule nor a rule of the list rejects; features spelled out."""
    kept = set()
    for d, t in texts.items():
        s = statistics(t)
        if s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]:
            continue
        per = lambda k, n: s[k] / max(1, s[n])
        x = {
            "n_words": float(s["n_words"]), "chars_per_word": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "dup_lines_per_line": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"),
            "upper_share": per("n_upper", "word_chars"), "marks_per_word": per("n_marks", "n_words"), "digit_share": per("n_digits", "word_chars"), "distinct_share": per("n_distinct", "n_words"), "words_per_line": per("n_words", "n_lines"), "stops_per_word": per("n_stops", "n_words"),
        }
        if not any(all(x[f] <= cut if op == "<=" else x[f] > cut for f, op, cut in r.conditions) for r in rules):
            kept.add(d)
    return kept
