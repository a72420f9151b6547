"""Operator 2, token counts by dynamic programming shared over a trie of pre-tokens.

A text's pre-tokens are its runs of non-space characters, led by the word mark.  Under a unigram
model the best segmentation of a pre-token is found by forward scores, and the score at a position
depends on the prefix up to it only.  The distinct pre-tokens not seen yet are put into a trie, whose
nodes are visited once each, parents first, so every shared prefix is scored once; a node that ends a
pre-token stores its token count and score.

The vocabulary is that of a public tokenizer.  Its pieces get fixed log probabilities by rank
(Zipf's law); a character outside it costs one token per UTF-8 byte.  Nothing is trained.

The work is a narrow pass over whole texts.  A worker keeps at most ``KEPT`` terminal counts and a
trie of the pre-tokens of ``SLICE`` documents.

Defined cases: a null or empty text, or one of spaces only, has no tokens and score 0; repeated rows
are counted each; an empty table gives no rows; extra columns are kept but for output names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from glazier.llm.common import column, read_table

WORD_MARK = "▁"
KEPT = 200_000
SLICE = 256
UNKNOWN = -25.0  # score of one byte of a character outside the vocabulary


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def unigram_scores(path: str) -> dict[str, float]:
    """Log probabilities of the vocabulary's ordinary pieces, falling with their rank."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 1) - total for rank, piece in enumerate(pieces)}


class PretokenTrie:
    """Trie of pre-tokens, visited by sorted order: a stack holds the path from the root, with the best
    score and its token count at each node of the path."""

    def __init__(self, scores: dict[str, float]):
        # The vocabulary as a trie of reversed pieces; a node's score is under "".
        self.reversed: dict = {}
        for piece, score in scores.items():
            node = self.reversed
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = score
        self.nodes = 0  # nodes scored so far

    def terminal_counts(self, pretokens) -> dict[str, tuple[int, float]]:
        """Token count and score of the best segmentation of every pre-token; of equal scores, the one
        with fewer tokens."""
        out, pieces, last = {}, self.reversed, ""
        best, count = [0.0], [0]
        for word in sorted(pretokens):
            depth, most = 0, min(len(word), len(last))
            while depth < most and word[depth] == last[depth]:
                depth += 1
            del best[depth + 1:], count[depth + 1:]
            for end in range(depth + 1, len(word) + 1):
                char = word[end - 1]
                width = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
                top, tokens = best[end - 1] + UNKNOWN * width, count[end - 1] + width
                # Back from the end as long as pieces end that way.
                start, node = end, pieces
                while start:
                    start -= 1
                    node = node.get(word[start])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        found = best[start] + piece
                        if found > top or found == top and count[start] + 1 < tokens:
                            top, tokens = found, count[start] + 1
                best.append(top)
                count.append(tokens)
            self.nodes += len(word) - depth
            out[word] = (count[-1], best[-1])
            last = word
        return out


def count_tokens(docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` (None: all) of ``docs`` with ``n_words``, ``n_tokens`` and the log ``score``."""
    path = vocabulary or vocabulary_file()
    docs = docs.drop("n_words", "n_tokens", "score")
    keep = list(docs.columns if keep is None else keep)
    kinds = docs.select(*keep).schema.add("n_words", "long").add("n_tokens", "long").add("score", "double")

    def count(batches):
        trie = PretokenTrie(unigram_scores(path))
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            texts = column(batch, text).to_pylist()
            rows = []
            for at in range(0, len(texts), SLICE):
                words = [[WORD_MARK + w for w in (t or "").split()] for t in texts[at:at + SLICE]]
                distinct = set().union(*words)
                new = distinct - known.keys()
                if len(known) + len(new) > KEPT:
                    known, new = {}, distinct
                known |= trie.terminal_counts(new)
                for ws in words:
                    found = [known[w] for w in ws]
                    rows.append((len(ws), sum(n for n, _ in found), math.fsum(s for _, s in found)))
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in keep], *[pa.array([r[i] for r in rows], t) for i, t in
                                                      enumerate((pa.int64(), pa.int64(), pa.float64()))]],
                [*keep, "n_words", "n_tokens", "score"])

    return docs.mapInArrow(count, kinds)


def op2_trie_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words, unigram tokens and score of all documents."""
    return count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
