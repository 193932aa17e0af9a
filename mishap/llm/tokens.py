"""Token counts by a linear longest-match automaton.

A trie of the vocabulary over bytes and a word-end mark gets failure links: where a word can't go
on from a node, the pieces that greedy longest match has found by then are popped, and their
number was computed with the link. Each byte is read once; only numbers are added, no piece is built.

The mark prefers pieces that end a word at its end. Where no such piece matches, a piece without the
mark may end the word: the mark that is left over is no token, unless it is a piece itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mishap.llm.shared import prepare, table

END = 256
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: Pieces of text that are words of their own: letters, one digit, other symbols.
_WORDS = re.compile(r"[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_CACHE = 500_000
_BUILT: dict[int, "Automaton"] = {}


def _byte_of() -> dict[str, int]:
    """The usual printable stand-ins for bytes: printable Latin-1 is itself, the rest come from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """Pieces as bytes, those that end a word with END, from a tokenizer file with "</w>" word ends."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special, byte_of = {t["content"] for t in model.get("added_tokens", [])}, _byte_of()
    out = []
    for piece in model["model"]["vocab"]:
        if piece not in special:
            body, end = (piece[:-4], (END,)) if piece.endswith("</w>") else (piece, ())
            out.append((*(byte_of[c] for c in body), *end))
    return sorted(out)


class Automaton:
    """Numbers of greedy longest-match pieces; `first` start a word, `rest` go on (default: the same).

    A word-end mark that no piece takes up counts nothing."""

    def __init__(self, first: Iterable[tuple[int, ...]], rest: Iterable[tuple[int, ...]] | None = None):
        self.next: list[dict[int, int]] = [{}, {}]  # node 0 starts words, node 1 goes on
        piece = [False, False]
        roots = [(0, list(first))] if rest is None else [(0, list(first)), (1, list(rest))]
        for root, pieces in roots:
            for p in pieces:
                node = root
                for c in p:
                    to = self.next[node].get(c)
                    if to is None:
                        to = self.next[node][c] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    node = to
                piece[node] = True
        if rest is None:
            self.next[1] = self.next[0]
        # the mark alone can be popped after any piece, for nothing if it is no piece
        alone = self.next[1].setdefault(END, len(self.next))
        if alone == len(self.next):
            self.next.append({})
            piece.append(False)
        free = -1 if piece[alone] else alone
        piece[alone] = True
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        level = [(0, c, v) for c, v in self.next[0].items()]
        if rest is not None:
            level += [(1, c, v) for c, v in self.next[1].items()]
        while level:  # breadth first
            deeper = []
            for parent, c, v in level:
                if piece[v]:
                    self.fail[v], self.pops[v] = 1, int(v != free)
                else:
                    z, popped = self.fail[parent], 0
                    while z >= 0 and c not in self.next[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z][c], self.pops[parent] + popped
                deeper += [(v, d, w) for d, w in self.next[v].items()]
            level = deeper

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1 (unknown) if greedy matching gets stuck at a byte; 0 of an empty word."""
        if not word:
            return 0
        follow, fail, pops = self.next, self.fail, self.pops
        node, n = 0, 0
        for c in (*word, END):
            to = follow[node].get(c)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                to = follow[node].get(c)
            node = to
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return n


def split_words(text: str | None) -> list[str]:
    """Lower-cased words of a text; null has none."""
    return _WORDS.findall((text or "").lower())


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_tokens, over whole lower-cased texts; null texts have none.

    A word with a byte at which no piece goes on is one unknown token. Rows that repeat count each.
    `vocabulary` is a tokenizer file with "</w>" word ends; a path that isn't there is an error.
    The vocabulary (a file on the driver, of bounded size) is broadcast; automata are built once a
    worker. Counts of words met before are looked up, in a table of bounded size."""
    spark = prepare(docs.sparkSession)
    pieces = load_vocabulary(vocabulary)
    sent, mark = spark.sparkContext.broadcast(pieces), hash(tuple(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _BUILT.get(mark)
        if automaton is None:
            _BUILT.clear()
            automaton = _BUILT[mark] = Automaton(sent.value)
        known: dict[str, int] = {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                found = split_words(text)
                total = 0
                for w in found:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= _CACHE:
                            known.clear()
                        n = known[w] = automaton.count(w.encode("utf-8", "surrogatepass"))
                    total += n
                words.append(len(found))
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
