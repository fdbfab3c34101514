"""Plain-Python versions of the operators' rules, for small tables. Rows are dicts; results are dicts by id."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

GAP = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[GAP.sub(" ", r["text"] or "")].append(r["doc_id"])
    return {
        i: (min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())
        for text, ids in groups.items()
        for i in ids
    }


def targets(rows, weights=(5, 2, 1), repeats=3):
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in held)
        left = total - sum(repeats * size[s] for s in held)
        target = {s: repeats * size[s] if s in held else left * weight[s] / free for s in order}
        more = {s for s in order if s not in held and target[s] > repeats * size[s]}
        if not more:
            return size, target
        held |= more


def substring(rows, k=20):
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        w = words(r["text"])
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen.setdefault(tuple(w[i : i + k]), (r["doc_id"], i)) != (r["doc_id"], i):
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[r["doc_id"]] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def quality_base(text):
    w, text = words(text), text or ""
    lines = [line for line in text.split("\n") if words(line)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    hit = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 5)}
    return (
        len(w),
        sum(map(len, w)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(hit),
        len(w) < 10 or 100 * len(hit) > 20 * len(w),
    )


def fingerprint(text, k=3):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, far=3):
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    least = {}
    for i in sorted(prints):
        least.setdefault(prints[i], i)
        root[i] = least[prints[i]]
    distinct = sorted(least)
    for n, a in enumerate(distinct):
        for b in distinct[:n]:
            if (a ^ b).bit_count() <= far:
                x, y = find(least[a]), find(least[b])
                root[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def payloads(rows):
    first = {}
    for r in rows:
        first[r["html"] or ""] = max(r["page_id"], first.get(r["html"] or "", r["page_id"]))
    out = {}
    for r in rows:
        data = (r["html"] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        to = first[r["html"] or ""]
        out[r["page_id"]] = (len(data), digest, *(("response", None) if to == r["page_id"] else ("revisit", to)))
    return out


def unigram(rows):
    def learn(r):
        return zlib.crc32(str(r["doc_id"]).encode()) % 10 != 0

    count = Counter()
    for r in rows:
        if learn(r):
            count.update([*words(lower(r["text"])), None])
    n, v = sum(count.values()), len(count)
    out = {}
    for r in rows:
        tokens = [*words(lower(r["text"])), None]
        base = sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out[r["doc_id"]] = (not learn(r), len(tokens), sum(count[t] > 0 for t in tokens), n, base)
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower(text))


def search(rows, items, k=10):
    """(item place, rank, doc_id, score) of the best documents; ids are whole numbers or null, null last."""
    held = [(r["doc_id"], Counter(terms(r["text"]))) for r in rows]
    n = [sum(c.values()) for _, c in held]
    many, total = sum(x > 0 for x in n), sum(n)
    df = Counter(t for _, c in held for t in c)
    out = []
    for place, item in enumerate(items):
        scores = []
        for (i, count), size in zip(held, n):
            m = 100 - 90 + (90 * size * many) // total if total else 10
            score = sum(
                math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((1000000000 * count[t]) // (1000 * count[t] + 8 * m))
                for t in set(terms(item))
                if count[t]
            )
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(place, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def shingle_set(text, k=3):
    w = words(lower(text))
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def jaccard(rows, percent=90):
    """{place of the row: (n_shingles, component_id)}."""
    sets = [shingle_set(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i]["doc_id"])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return {i: (len(sets[i]), least[find(i)]) for i in range(len(rows))}


def run_counts(texts, longest=3, buckets=10000):
    out = Counter()
    for text in texts:
        w = terms(text)
        for n in range(1, longest + 1):
            out.update(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for i in range(len(w) - n + 1))
    return out


def resample(rows, target, percent=5, min_words=20, buckets=10000):
    """[(doc_id, n_features, weight, score, rank)] in the order of the rows."""
    raw, wanted = run_counts(r["text"] for r in rows), run_counts(target)
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    out = []
    for r in rows:
        own = run_counts([r["text"]])
        gain = {
            b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in own
        }
        h = int(hashlib.sha256(f"42:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in own.items())
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r["doc_id"], sum(own.values()), weight, score, None])
    able = [i for i, r in enumerate(rows) if len(terms(r["text"])) >= min_words]
    able.sort(key=lambda i: (-out[i][3], rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0))
    for rank, i in enumerate(able[: percent * len(able) // 100], 1):
        out[i][4] = rank
    return [tuple(x) for x in out]
