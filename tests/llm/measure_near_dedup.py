"""Recall of near-dedup: python -m tests.llm.measure_near_dedup DIR compares all components of DIR's documents with brute force.

Brute force counts the shingles that each class of equal texts shares with every other, from an
inverted index over all classes; no signatures and no buckets."""

import sys
import time

import numpy as np
import xxhash
from pyspark.sql import SparkSession

from mishap.llm import minhash


def classes(rows):
    """(ids of each class of equal shingle sets, sorted shingle numbers of each class); rows without words are left out."""
    number, members, sets = {}, {}, []
    for i, text in rows:
        words = (text or "").encode().translate(minhash._BYTES).split()
        if words:
            found = {xxhash.xxh3_64_intdigest(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))}
            own = np.unique(np.array([number.setdefault(x, len(number)) for x in found]))
            key = (len(own), xxhash.xxh3_128_digest(own.tobytes()))
            if key not in members:
                members[key] = []
                sets.append(own)
            members[key].append(i)
    return list(members.values()), sets, len(number)


def labels(ids, sets, shingles):
    """(smallest id reachable of each id, links between classes)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    owner, start = owner[order], np.searchsorted(every[order], np.arange(shingles + 1))
    sizes, parent, links = np.array([len(s) for s in sets]), list(range(len(sets))), []

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for c, own in enumerate(sets):
        both = np.bincount(np.concatenate([owner[start[s] : start[s + 1]] for s in own.tolist()]), minlength=0)
        other = np.flatnonzero(both)
        other = other[other < c]
        for o in other[100 * both[other] >= 75 * (sizes[other] + sizes[c] - both[other])].tolist():
            links.append((o, c))
            a, b = root(o), root(c)
            parent[max(a, b)] = min(a, b)
    first = {}
    for c, own in enumerate(ids):
        first[root(c)] = min(first.get(root(c), own[0]), *own)
    return {i: first[root(c)] for c, own in enumerate(ids) for i in own}, len(links)


if __name__ == "__main__":
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "file:///tmp/near").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.read.parquet(f"{sys.argv[1]}/documents.parquet").select("doc_id", "text")
    began = time.time()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).select("doc_id", "component_id").collect()}
    took = time.time() - began
    ids, sets, shingles = classes((r.doc_id, r.text) for r in docs.toLocalIterator())
    want, links = labels(ids, sets, shingles)
    odd = [i for i in got if got[i] != want.get(i, i)]
    print(f"{sys.argv[1]}: {len(got)} documents, {len(ids)} classes, {links} links between classes, {len(set(want.values()))} components; {len(odd)} documents with another component; {took:.0f} s of Spark")
