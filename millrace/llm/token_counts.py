"""Token counts by a linear longest-match automaton (operator 10).

A vocabulary of word pieces becomes a trie. Every node has a failure link and the number of pieces that
following the link pops, both computed before any text is read, so that greedy longest-match-first piece
lengths of a word come from one pass over its characters: no piece is built and no character read twice.

Semantics. Words are the runs of characters that aren't white space (``str.split``). A word is matched as
``mark + word``; the greedy pieces are counted. A word that the vocabulary can't cover counts as one unknown
token. Null and empty texts have no words and no tokens. Repeated rows and ties get equal counts.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, table

MARK = "▁"
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_unknown", T.LongType())])


def load_pieces(path: str) -> list[str]:
    """The text pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class LongestMatch:
    """The automaton. ``count(word)`` is the number of greedy pieces, or -1 where the word can't be covered."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends = [False]
        for p in pieces:
            at = 0
            for ch in p:
                to = self.next[at].get(ch)
                if to is None:
                    to = len(ends)
                    self.next[at][ch] = to
                    self.next.append({})
                    ends.append(False)
                at = to
            ends[at] = at != 0
        # fail[v]: the node of what is left when the pieces at the start of v's string are popped; -1: it can't be popped.
        n = len(ends)
        self.fail, self.pops, self.ends = [-1] * n, [0] * n, ends
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for ch, v in self.next[u].items():
                if ends[v]:
                    self.fail[v], self.pops[v] = 0, 1
                elif u:
                    at, popped = self.fail[u], self.pops[u]
                    while at >= 0 and ch not in self.next[at]:
                        popped += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[v], self.pops[v] = self.next[at][ch], popped
                todo.append(v)

    def count(self, word: str) -> int:
        step, fail, pops = self.next, self.fail, self.pops
        at = n = 0
        for ch in word:
            to = step[at].get(ch)
            while to is None:
                if at == 0 or fail[at] < 0:
                    return -1
                n += pops[at]
                at = fail[at]
                to = step[at].get(ch)
            at = to
        while at:
            if fail[at] < 0:
                return -1
            n += pops[at]
            at = fail[at]
        return n


#: Words whose counts a task remembers. The memory is cleared when full: it bounds memory, never results.
MEMO_WORDS = 400_000


def counter(automaton: LongestMatch, mark: str = MARK):
    memo: dict[str, int] = {}

    class Memo(dict):
        def __missing__(self, w):
            self[w] = c = automaton.count(mark + w)
            return c

    memo = Memo()

    def fn(texts: list) -> list:
        words, tokens, unknown = [], [], []
        for t in texts:
            w = t.split() if t else []
            n = np.fromiter(map(memo.__getitem__, w), dtype=np.int64, count=len(w))
            bad = int((n < 0).sum())
            words.append(len(w))
            tokens.append(int(n.sum()) + 2 * bad)
            unknown.append(bad)
            if len(memo) > MEMO_WORDS:
                memo.clear()
        return [words, tokens, unknown]

    return fn


def token_counts(docs: DataFrame, pieces: list[str], id_col: str = "doc_id", text_col: str = "text", mark: str = MARK) -> DataFrame:
    """id_col, n_words, n_tokens, n_unknown of each row. Other columns are ignored; an empty table gives no rows.

    The automaton is as large as the vocabulary and goes to each executor once, as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(pieces))
    return map_texts(docs, text_col, lambda: counter(shared.value, mark), FIELDS, [id_col])


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts(table(spark, sf_dir, "documents"), load_pieces(vocabulary))
