"""Text and plain versions for tests."""

import hashlib
import math
import re
from collections import defaultdict

from helixframe.llm import quality
from helixframe.llm.common import space_words

SYL = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYL) for _ in range(rng.randint(1, 4))) for _ in range(n))


def jaccard_components(rows, shingle):
    sets = {}
    for i, text in rows:
        w = space_words((text or "").encode(), lower=True)
        k = min(shingle, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in ids}


def brute_contamination(text, bench):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = word.findall(low(text))
    hit, items = set(), set()
    for i, t in bench:
        b = word.findall(low(t))
        n = min(13, len(b))
        for s in range(len(b) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[s : s + n]:
                    hit.update(range(p, p + n))
                    items.add("" if i is None else str(i))
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


def plain_contaminated(texts, items, size=13):
    """Whether at least a twentieth of a text's words stand in windows of the items."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[s : s + size]) for w in map(words, items) if w for s in range(max(len(w) - size, 0) + 1)}
    lengths = {len(x) for x in windows}
    out = []
    for w in map(words, texts):
        hit = {p + j for n in lengths for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for j in range(n)}
        out.append(len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def plain_targets(sizes, weights=(3, 1, 2)):
    total = 1.5 * sum(s for _, s in sizes)
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    target, open_sources = {}, dict(order)
    while open_sources:
        left = total - sum(target.values())
        whole = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if left * weight[s] / whole > 2 * open_sources[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in open_sources}
            break
        for s in over:
            target[s] = 2.0 * open_sources.pop(s)
    return target


def plain_posteriors(sections, chance):
    """Posteriors of documents in (host, path) sections, from their evidence."""

    def strength(groups):
        groups = [g for g in groups if len(g) > 1]
        if len(groups) < 2:
            return quality.STRENGTH[1]
        n, k = sum(map(len, groups)), len(groups)
        mean = sum(map(sum, groups)) / n
        within = sum((x - sum(g) / len(g)) ** 2 for g in groups for x in g) / max(n - k, 1)
        between = sum(len(g) * (sum(g) / len(g)) ** 2 for g in groups) / n - mean**2 - within * (k - 1) / n
        found = max(mean * (1 - mean), 1e-6) / between - 1 if between > 0 else quality.STRENGTH[1]
        return min(max(found, quality.STRENGTH[0]), quality.STRENGTH[1])

    hosts, paths = defaultdict(list), defaultdict(list)
    for section, p in zip(sections, chance, strict=True):
        hosts[section[0]].append(p)
        paths[section].append(p)
    share, a, b = sum(chance) / len(chance), strength(hosts.values()), strength(paths.values())
    logit = lambda p: math.log(p / (1 - p))
    bound = lambda p: min(max(p, 1e-4), 1 - 1e-4)
    out = []
    for section, p in zip(sections, chance, strict=True):
        host, path = hosts[section[0]], paths[section]
        host_share = (a * share + sum(host)) / (a + len(host))
        site = bound((b * host_share + sum(path) - p) / (b + len(path) - 1))
        out.append(1 / (1 + math.exp(-(logit(p) - logit(bound(share)) + logit(site)))))
    return out
