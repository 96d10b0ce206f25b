"""Plain definitions of what the operators return, for small inputs."""

import hashlib
import re

SPACE = "[\\x20\\x09-\\x0D]"
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, width=5):
    w = words(lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_groups(rows, percent=75):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, holders = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in holders[s] if j > i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_words(rows, size=50):
    """{doc_id: (n_words, n_removed, sha of the kept words)}."""
    texts = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - size + 1):
            first.setdefault(tuple(texts[i][k : k + size]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), sha(kept))
    return out


def repeated_bytes(rows, size=200):
    """[(doc_id, n_bytes, n_removed, n_spans, sha of the kept bytes)] in the order of the rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for _, data in texts:
        for k in range(len(data) - size + 1):
            window = data[k : k + size]
            seen[window] = seen.get(window, 0) + 1
    out = []
    for i, data in texts:
        gone = bytearray(len(data))
        for k in range(len(data) - size + 1):
            if seen[data[k : k + size]] > 1:
                gone[k : k + size] = b"\x01" * size
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), sum(gone), spans, sha(kept)))
    return out


def quality_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text, w = text or "", words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = {}
    for k in range(len(w) - 7):
        grams.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {k + i for places in grams.values() if len(places) > 1 for k in places for i in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), dup, len(covered), failed


KEYS = re.compile("""(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    """[(start, kind order, end)] of the base patterns."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in KEYS.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def base_row(text):
    """n_assign, n_access, n_hex, base_sha256."""
    spans = base_secrets(text)
    names = ("assign", "access", "hex")
    listed = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    return *(sum(k == i for _, k, _ in spans) for i in range(3)), sha(listed)
