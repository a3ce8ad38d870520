"""Token counts of a unigram model, with pre-tokens in a trie that shares the forward scores of their prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: A trie is started anew beyond this many nodes, and longer words are scored beside it; the counts stay the same.
TRIE_NODES = 400_000
WORD_CHARS = 256
#: Score of an unknown character below the lowest piece.
UNKNOWN_PENALTY = 10.0


def pieces(model: str) -> tuple[dict[str, float], float, int]:
    """Scores of the model's pieces, the score of an unknown character, and the length of the longest piece."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    scores = {
        processor.id_to_piece(i): processor.get_score(i)
        for i in range(processor.get_piece_size())
        if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i))
    }
    return scores, min(scores.values()) - UNKNOWN_PENALTY, max(map(len, scores))


class Trie:
    """Forward scores of pre-tokens; a prefix that several pre-tokens share is scored once."""

    def __init__(self, scores: dict[str, float], unknown: float, longest: int) -> None:
        self.scores, self.unknown, self.longest = scores, unknown, longest
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def forward(self, text: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score and token count of text[:end] from those of its shorter prefixes; the longer last piece wins ties.

        An unknown character is as many tokens as it has bytes.
        """
        top, count = float("-inf"), 0
        for start in range(max(0, end - self.longest), end):
            score = self.scores.get(text[start:end])
            if score is not None and best[start] + score > top:
                top, count = best[start] + score, tokens[start] + 1
        if text[end - 1 : end] not in self.scores and best[end - 1] + self.unknown > top:
            top, count = best[end - 1] + self.unknown, tokens[end - 1] + len(text[end - 1].encode())
        return top, count

    def add(self, word: str) -> int:
        """Tokens of a pre-token."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        keep = len(word) <= WORD_CHARS
        if keep and len(self.best) > TRIE_NODES:
            self.clear()
        best, tokens, node = [0.0], [0], 0
        for end in range(1, len(word) + 1):
            step = self.child.get((node, word[end - 1])) if keep else None
            if step is None:
                score, count = self.forward(word, end, best, tokens)
                if keep:
                    step = len(self.best)
                    self.child[node, word[end - 1]] = step
                    self.best.append(score)
                    self.tokens.append(count)
            else:
                score, count = self.best[step], self.tokens[step]
            best.append(score)
            tokens.append(count)
            node = step
        if keep:
            self.terminal[word] = tokens[-1]
        return tokens[-1]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of every row; `model` is a file of pieces with scores.

    A pre-token is a word mark and what stands up to the next space or line end; each line end is a pre-token too. A
    null or empty text has none.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(*pieces(model))
        line_end = trie.add("\n")
        for batch in batches:
            words, tokens = [], []
            for text in batch["text"]:
                lines = (text.as_py() or "").split("\n")
                total, seen = line_end * (len(lines) - 1), len(lines) - 1
                for line in lines:
                    if line:
                        own = (SPACE + line.replace(" ", " " + SPACE)).split(" ")
                        seen += len(own)
                        total += sum(map(trie.add, own))
                words.append(seen)
                tokens.append(total)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(per_batch, "doc_id long, n_pretokens long, n_tokens long")
