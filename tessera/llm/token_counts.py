"""Token counts by trie-shared dynamic programming.

The vocabulary is a public sentencepiece file; its path is a parameter. A
piece's log probability follows its rank in the file by Zipf's law,
``-ln(rank + 1) - ln(H)``; byte pieces (the fall-back for characters that no
piece covers) cost ``BYTE_COST`` each below the least piece. Pre-tokens are the
words between white space, with the mark U+2581 in front.

A task keeps one trie of the distinct pre-tokens it has met. The score of a
trie node is the best score of any segmentation of its prefix: the maximum,
over the pieces that end there, of the score where the piece starts plus its
log probability, ties going to fewer tokens. A prefix is scored once, however many
pre-tokens share it: new pre-tokens of a chunk are visited in sorted order, and
the scores along the shared prefix with the one before are the path of the trie
that is still on the stack. A terminal stores its token count; a document's
count is the sum over its words.

Scale: a narrow map. The terminal table of a task is emptied when it holds
``MAX_TERMINALS`` pre-tokens, which costs time but changes no result. The cost of
a word is linear in its length.

Defined results: null, empty or blank text has 0 tokens; repeated rows are
counted one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession

from .common import map_docs, table

MARK = "▁"
BYTE_COST = 10.0
MAX_TERMINALS = 800_000
UNDEFINED = -math.inf


def default_vocabulary() -> str:
    return os.environ.get("TOKENIZER_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


class Pieces:
    """Log probabilities by piece, and the byte fall-back."""

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores = scores
        self.byte_score = byte_score
        self.longest = max(map(len, scores), default=1)
        ends: dict[str, set[int]] = {}
        for p in scores:
            ends.setdefault(p[-1], set()).add(len(p))
        #: lengths that a piece ending in this character can have
        self.lengths = {c: sorted(ls) for c, ls in ends.items()}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [
            sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
        ]
        norm = math.log(sum(1 / (r + 1) for r in range(len(normal))))
        scores = {p: -math.log(r + 1) - norm for r, p in enumerate(normal)}
        return cls(scores, min(scores.values()) - BYTE_COST)


class PrefixTrie:
    """Terminal counts of the pre-tokens met so far; prefixes are scored while they stand on the stack."""

    def __init__(self, pieces: Pieces, max_terminals: int = MAX_TERMINALS):
        self.pieces = pieces
        self.max_terminals = max_terminals
        self.terminals: dict[str, int] = {}
        self.nodes_scored = 0

    def add(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.terminals)
        if len(self.terminals) + len(new) > self.max_terminals:
            self.terminals = {}
            new = sorted(words)
        scores, lengths = self.pieces.scores, self.pieces.lengths
        byte_score = self.pieces.byte_score
        best, count = [0.0], [0]  # along the current path of the trie; index = depth
        path = ""
        for word in new:
            marked = MARK + word
            shared = 0
            for a, b in zip(path, marked):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(marked) + 1):
                c = marked[end - 1]
                n_bytes = len(c.encode("utf-8", "surrogatepass"))
                top = n = None
                for size in lengths.get(c, ()):
                    if size > end:
                        break
                    p = scores.get(marked[end - size : end])
                    if p is not None:
                        s = best[end - size] + p
                        k = count[end - size] + 1
                        if top is None or s > top or (s == top and k < n):
                            top, n = s, k
                if c not in scores:
                    s = best[end - 1] + n_bytes * byte_score
                    k = count[end - 1] + n_bytes
                    if top is None or s > top or (s == top and k < n):
                        top, n = s, k
                best.append(top)
                count.append(n)
            self.nodes_scored += len(marked) - shared
            self.terminals[word] = count[-1]
            path = marked


def count_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens). The driver reads the vocabulary once; tasks get its pieces."""
    pieces = Pieces.load(vocabulary or default_vocabulary())
    shared = docs.sparkSession.sparkContext.broadcast((pieces.scores, pieces.byte_score))
    held: dict = {}

    def per_batch(ids: list, texts: list) -> dict:
        if "trie" not in held:
            held["trie"] = PrefixTrie(Pieces(*shared.value))
        trie = held["trie"]
        split = [t.split() for t in texts]
        trie.add({w for words in split for w in words})
        known = trie.terminals
        return {"doc_id": ids, "n_pretokens": [len(w) for w in split], "n_tokens": [sum(map(known.__getitem__, w)) for w in split]}

    return map_docs(docs, per_batch, "doc_id long, n_pretokens long, n_tokens long", id_col, text_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents"))
