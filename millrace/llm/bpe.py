"""Byte-level BPE encoding and decoding by tree concatenation (operator 7).

A long text isn't encoded in one go. It is halved until the parts are short, the parts are encoded side by
side by a pool of threads, and the halves are joined upwards: around each join a window is encoded anew and grows
until both sides agree with it exactly. Two levels need this:

* Text. The pre-tokenizer reads left to right and looks at most a few characters ahead, so a piece that ends
  well before the cut is final; the window starts at the last such piece, and once one of the window's piece
  boundaries is a boundary of the right half too, all that follows is the same. The window grows till then.
* One long piece without any boundary (a run of letters, say). The window of tokens around the join grows
  until the token pairs at both its edges are ones that the merges leave apart: a token sequence whose
  neighbouring pairs all encode to themselves is the encoding of the whole.

Results equal ``tokenizers``' ``encode(text, add_special_tokens=False)`` and ``decode(ids,
skip_special_tokens=False)`` for the given file. Merges are taken from the file's list of merges, whatever the ids.
A file for which that can't be exact (two merges into one token, a token that its merges don't reach) is refused.

Semantics. Null texts count as empty: no tokens, empty decoding. Rows are encoded one by one, so ties and repeated
rows give equal rows. Texts of any script and length go through the tree. Columns are told apart by place, so
extra columns may have any name; of columns named like a result, the result stays. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, table

#: Characters of a leaf, and bytes of a leaf inside one long piece.
LEAF_CHARS, LEAF_BYTES = 16_384, 1_024
#: Threads that encode the leaves of one text.
THREADS = 4
#: All other code points' classes have long been the same in every library. Texts with these are cut into pieces by the tokenizers library.
SETTLED = re.compile("[^\\x00-\\u04ff\\u2010-\\u206f\\u20ac]")
# Fixed value: the pre-tokenizer's pattern of this kind of vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that the pattern can look at beyond the start of a piece to choose a contraction.
AHEAD = 3


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one tokenizer file's content. A file that this can't treat exactly is refused."""

    def __init__(self, content: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(content)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or spec.get("normalizer") or spec.get("post_processor") or model.get("ignore_merges") or model.get("dropout") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only byte-level BPE files without normalizer, prefix space or post-processor")
        self.hf = Tokenizer.from_str(content)
        self.hf.no_truncation()
        self.hf.no_padding()
        letters, added = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {w: i for w, i in model["vocab"].items() if w not in added}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if len(set(made)) < len(made) or any(len(self.hf.model.tokenize(w)) != 1 for w in made) or any(c not in vocab for c in letters):
            raise ValueError("only files whose merges make each token once and all of it")
        raw = lambda w: bytes(letters[c] for c in w)
        ids = [vocab[c] for c in letters] + [vocab[w] for w in made]
        # Where ids are in the order of the merges they are the ranks themselves.
        ordered = all(x < y for x, y in zip(ids[256:], ids[257:], strict=False))
        ranks = {raw(w): i if not ordered else ids[i] for i, w in enumerate([*letters, *made])}
        self.id_of = None if ordered else ids
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.of_rank = {i: w for w, i in ranks.items()}
        self.bytes_of = {i: raw(w) for w, i in vocab.items()} | {i: w.encode() for w, i in added.items()}
        self.shown = {i: str(i) for i in self.bytes_of}
        self.core = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(PIECES)
        self.pre = self.hf.pre_tokenizer

    # Leaves. Tokens are ranks from here on to ``ids``.

    def leaf(self, text: str) -> list[int]:
        """All of a short text that has no added token."""
        if SETTLED.search(text):
            return [t for p in self.spans(text, False)[1] for t in p]
        return self.core.encode_ordinary(text)

    # One long piece: tokens over bytes.

    def piece(self, raw: bytes) -> list[int]:
        if len(raw) <= LEAF_BYTES:
            return self.core._encode_single_piece(raw)
        half = len(raw) // 2
        return self.join_tokens(self.piece(raw[:half]), self.piece(raw[half:]))

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave two neighbouring tokens as they are."""
        return self.core._encode_single_piece(self.of_rank[a] + self.of_rank[b]) == [a, b]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            mid = self.core._encode_single_piece(b"".join(self.of_rank[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.apart(left[i - 1], mid[0])) and (j == len(right) or self.apart(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            k *= 2

    # Text: pieces with their ends, and the tokens of each piece.

    def spans(self, text: str, settled: bool = True) -> tuple[list[int], list[list[int]]]:
        """Ends of the pieces of a text and the tokens of each."""
        found = self.pieces.findall(text) if settled else [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return list(accumulate(map(len, found))), [self.piece(p.encode("utf-8", "surrogatepass")) for p in found]

    def join_spans(self, text: str, cut: int, left: tuple, right: tuple, settled: bool = True) -> tuple[list[int], list[list[int]]]:
        """left covers text[:cut], right the rest; ends count from each part's start."""
        (le, lt), (re_, rt) = left, right
        keep = len(le)
        while keep and (le[keep - 1] >= cut or (le[keep - 2] if keep > 1 else 0) + AHEAD > cut):
            keep -= 1
        begin, grow = le[keep - 1] if keep else 0, 8
        bounds = {cut + e: n for n, e in enumerate(re_)}
        while True:
            last = min(len(re_), grow) - 1
            stop = cut + (re_[last] if re_ else 0)
            # One more character is seen than is kept, and pieces near the window's end are not final.
            ends, tokens = self.spans(text[begin : min(len(text), stop + AHEAD)], settled)
            for n, e in enumerate(ends):
                at = begin + e
                final = at == len(text) or at < stop and (ends[n - 1] if n else 0) + AHEAD <= stop + AHEAD - begin
                if final and at in bounds:
                    r = bounds[at] + 1
                    return le[:keep] + [begin + x for x in ends[: n + 1]] + [cut + x for x in re_[r:]], lt[:keep] + tokens[: n + 1] + rt[r:]
                if final and at == len(text):
                    return le[:keep] + [begin + x for x in ends[: n + 1]], lt[:keep] + tokens[: n + 1]
            grow *= 2

    def tree(self, text: str, leaf: int, pool: ThreadPoolExecutor | None = None) -> tuple[list[int], list[list[int]]]:
        settled, leaves = not SETTLED.search(text), []

        def halve(a: int, b: int):
            """The number of a leaf, or a pair of halves."""
            if b - a <= leaf:
                leaves.append((a, b))
                return len(leaves) - 1
            cut = a + (b - a) // 2
            return halve(a, cut), halve(cut, b)

        shape = halve(0, len(text))
        encode = lambda r: self.spans(text[r[0] : r[1]], settled)
        parts = list((pool.map if pool else map)(encode, leaves))

        def join(node) -> tuple[int, int, tuple]:
            if isinstance(node, int):
                return *leaves[node], parts[node]
            (a, cut, left), (_, b, right) = join(node[0]), join(node[1])
            return a, b, self.join_spans(text[a:b], cut - a, left, right, settled)

        return join(shape)[2]

    def ids(self, text: str, leaf: int = LEAF_CHARS, pool: ThreadPoolExecutor | None = None) -> list[int]:
        out: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.added:
                out.append(self.added[part])
                continue
            ranks = self.leaf(part) if len(part) <= leaf else [t for p in self.tree(part, leaf, pool)[1] for t in p]
            out += ranks if self.id_of is None else map(self.id_of.__getitem__, ranks)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def digest(bpe: Bpe, leaf: int = LEAF_CHARS):
    pool = ThreadPoolExecutor(THREADS)

    def fn(texts: list) -> list:
        out: list[tuple] = []
        for t in texts:
            ids = bpe.ids(t or "", leaf, pool)
            shown = ",".join(map(bpe.shown.__getitem__, ids))
            out.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
        return [list(x) for x in zip(*out, strict=True)] or [[], [], []]

    return fn


def content_of(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, content: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` to the columns ``keep`` (all). The tokenizer's content, a few MB, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def make():
        bpe = Bpe(shared.value)
        return lambda ts: [[bpe.ids(t or "") for t in ts]]

    return map_texts(docs, text_col, make, IDS, keep)


def token_digest(docs: DataFrame, content: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(content)
    return map_texts(docs, text_col, lambda: digest(Bpe(shared.value)), FIELDS, keep or [id_col])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), content_of(path or default_path()))
