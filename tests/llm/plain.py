"""Plain versions of operators, by loops over all rows, to compare with."""

import math
import re
import zlib

import numpy as np

from keepwell.llm import toxicity
from keepwell.llm.quality_classifier import STATISTICS, statistics

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def in_training(doc_id, divisor, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % divisor != rest


def toxicity_scores(texts, known, k=8, least=16.0):
    """The score of each of ``texts`` by the k nearest of ``known``, places in it with labels: all pairs."""
    counts, families = [toxicity.count_terms(t) for t in texts], [toxicity.family(t) for t in texts]
    n1, n0 = (len({families[i] for i, y in known if y == c}) for c in (1, 0))
    n, weight = n1 + n0, {}
    for t in set().union(*(counts[i] for i, _ in known)):
        one, zero = (len({families[i] for i, y in known if y == c and t in counts[i]}) for c in (1, 0))
        both = one + zero
        if both >= 2 and n0 and n1:
            apart = max(abs(one * (n0 - zero) - zero * (n1 - one)) - n / 2, 0)
            weight[t] = (math.log(n / both) + 1) * (1 + n * apart * apart / max(both * (n - both) * n1 * n0, 1) / least)

    def vector(i):
        raw = {t: (1 + math.log(c)) * weight[t] for t, c in counts[i].items() if t in weight}
        size = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / size for t, v in raw.items()}

    vectors = [vector(i) for i in range(len(texts))]
    bare = [y for i, y in known if not vectors[i]]
    base = (sum(bare) + (sum(y for _, y in known) + 0.5) / (len(known) + 1)) / (len(bare) + 1)
    used = [(i, y) for i, y in known if vectors[i]]

    def share(q, without=None):
        each = [(round(sum(v * vectors[i].get(t, 0) for t, v in vectors[q].items()), 12), y) for i, y in used if i != without]
        best = sorted([x for x in each if x[0] > 0], key=lambda x: -x[0])[:k]
        return (sum(s * y for s, y in best) + 0.1 * base) / (sum(s for s, _ in best) + 0.1)

    own = np.array([share(i, i) for i, _ in used])
    line = toxicity.calibrate(own, np.array([y for _, y in used]), np.ones(len(used)))
    return [toxicity.calibrated(share(q) if vectors[q] else base, *line) for q in range(len(texts))]


def quality_scores(texts, known, shrinkage=0.05):
    """The discriminant in closed form over the statistics of each text alone."""
    x = np.vstack([statistics(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for t in texts])
    train, y, d = x[[i for i, _ in known]], np.array([c for _, c in known]), len(STATISTICS)
    scale, logs = train.std(0) + 1e-6, []
    for c in (0, 1):
        mean = train[y == c].mean(0)
        z = (train[y == c] - mean) / scale
        cov, n = z.T @ z / len(z), len(z)
        part = shrinkage + (1 - shrinkage) * d / (n + d)
        cov = (1 - part) * cov + part * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        own = (x - mean) / scale
        logs.append(math.log((y == c).mean()) - 0.5 * (np.linalg.slogdet(cov)[1] + (own @ np.linalg.inv(cov) * own).sum(1)))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def near_groups(texts, width=5, percent=80):
    """The smallest place that each text's links reach: all pairs."""
    sets, group = [shingles(t, width) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group
