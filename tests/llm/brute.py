"""Plain versions of the operators, to compare with on small inputs."""

import hashlib


def repeats(rows, length):
    """rows: (doc_id, bytes) -> {doc_id: (n_bytes, n_removed, n_spans, sha256)}."""
    seen, out = set(), {}
    for doc, data in sorted(rows):
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            piece = data[s : s + length]
            if piece in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def nearest(rows, every, k, scale=1024):
    import math

    v = {i: [math.floor(scale * float(x)) for x in e] for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in sorted(v):
        if q % every == 0:
            got = sorted((-sum(a * b for a, b in zip(v[q], w)), i) for i, w in v.items() if i != q and len(w) == len(v[q]))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(got, 1)]
    return out
