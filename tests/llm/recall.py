"""python -m tests.llm.recall [DIRECTORY]: op5's classes against brute force over a whole documents table, by ranges of similarity.

A pair's brute force is exact: of two bags with a similarity of 0.8 or more, the rarest fifth of each one's elements (and one more)
have one in common, so texts meet by those, and every pair that meets is compared by all its shingles. Not a test: pytest doesn't gather it.
"""

from __future__ import annotations

import math
import sys
from collections import Counter, defaultdict

from millrace.llm import bagminhash
from millrace.session import build_session
from millrace.sources.tables import load


def shingles(text: str) -> Counter:
    """The bag that ``bagminhash.bag`` says a text has, by its own hashes."""
    return Counter(dict(zip(*(x.tolist() for x in bagminhash.bag(text)), strict=True)))


def likeness(x: Counter, y: Counter) -> float:
    """Weighted Jaccard similarity."""
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def near_pairs(bags: list[Counter], threshold: float):
    """Each pair of bags of at least the threshold, with its likeness."""
    held = Counter(e for b in bags for e in b)
    met = defaultdict(list)
    for i, b in enumerate(bags):
        elements = sorted(((e, n) for e, k in b.items() for n in range(k)), key=lambda e: (held[e[0]], e))
        candidates = set()
        for e in elements[: len(elements) - math.ceil(threshold * len(elements)) + 1]:
            candidates.update(met[e])
            met[e].append(i)
        for j in candidates:
            s = likeness(b, bags[j])
            if s >= threshold:
                yield i, j, s


def main(folder: str) -> None:
    """Print, for each range of similarity, how many pairs of distinct texts there are and how many of them share a class."""
    spark = build_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    docs = load(spark, folder, "documents")
    named = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(docs).collect()}
    texts = {r["text"] or "": r["doc_id"] for r in docs.select("doc_id", "text").collect()}
    bags, ids = zip(*((b, k) for t, k in texts.items() if (b := shingles(t))), strict=True)
    total, found, up = Counter(), Counter(), {k: k for k in ids}

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for i, j, s in near_pairs(list(bags), bagminhash.THRESHOLD):
        low = min(int(s * 20), 19) / 20
        total[low] += 1
        found[low] += named[ids[i]] == named[ids[j]]
        up[root(ids[i])] = root(ids[j])
    for low in sorted(total):
        print(f"{low:.2f} to {low + 0.05:.2f}: {found[low]} of {total[low]} pairs, {found[low] / total[low]:.4f}")
    print(f"classes of distinct texts: {len({named[k] for k in ids})}, by brute force {len({root(k) for k in ids})}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")
