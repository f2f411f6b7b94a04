"""Brute-force versions of the text operators, on lists of Python texts."""

import zlib

import numpy as np


def check_packing(pieces, docs, tokenizer, window=1024):
    """Pieces cover each document once, sequences are gapless and need no padding."""
    ids = {
        d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for d, t in docs
    }
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window and at & (at - 1) == 0


def words(text):
    return (text or "").encode("utf-8").split()


def counts(text, window=8):
    """The base counts of the quality rules."""
    ws = words(text)
    grams = [tuple(ws[i : i + window]) for i in range(len(ws) - window + 1)]
    twice = {i for i, g in enumerate(grams) if grams.count(g) > 1}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(ws),
        sum(len(w.decode()) for w in ws),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len({i + k for i in twice for k in range(window)}),
    )


def repeated(docs, length=13):
    """(n_words, n_removed, kept) per document, window by window."""
    first = {}
    for d, t in docs:
        ws = words(t)
        for i in range(len(ws) - length + 1):
            key = tuple(ws[i : i + length])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in docs:
        ws = words(t)
        gone = set()
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < d:
                gone |= set(range(i, i + length))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()
        out[d] = (len(ws), len(gone), kept)
    return out


def near_classes(docs, length=5, percent=80):
    """(n_shingles, class) per document from all pairs."""
    sets = {}
    for d, t in docs:
        ws = (t or "").encode().lower().split()
        n = max(1, len(ws) - length + 1) if ws else 0
        sets[d] = {tuple(ws[i : i + length]) for i in range(n)}
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}
