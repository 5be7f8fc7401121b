"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at a character, longest first. The Viterbi
recursion over ends carries the best score and its number of pieces, and nothing to trace back. A later
candidate must be strictly better, so of equal scores the piece that starts first wins, as in the tokenizer.
A character that is no piece costs the lowest score less ten and counts as its UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1 << 20


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece file and their scores; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in odd)}


class Counter(dict):
    """Counts of the words met so far; a new word is counted when it is asked for."""

    def __init__(self, pieces: dict[str, float]):
        super().__init__()
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece goes on after a word's end, so words cannot be counted one by one")
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        if pieces:
            self.automaton.make_automaton()
        self.match = self.automaton.iter if pieces else lambda _: ()
        # A word with the blanks before it, or the blanks at the end.
        self.words = re.compile(r" *[^ ]+| +").findall

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = n = self.pieces(BLANK + word.replace(" ", BLANK))
        return n

    def pieces(self, text: str) -> int:
        """Number of pieces of the best segmentation."""
        n, single, unknown = len(text), self.single, self.unknown
        best, count, ready = [0.0] + [float("-inf")] * n, [0] * (n + 1), 0
        for last, (size, score) in [*self.match(text), (n, (0, 0.0))]:
            # Ends before this one have all their pieces; the unknown character starts last and so comes last.
            while ready < last:
                c = text[ready]
                ready += 1
                if c not in single and (s := best[ready - 1] + unknown) > best[ready]:
                    best[ready], count[ready] = s, count[ready - 1] + len(c.encode())
            if size and (s := best[last + 1 - size] + score) > best[last + 1]:
                best[last + 1], count[last + 1] = s, count[last + 1 - size] + 1
        return count[n]

    def count(self, text: str) -> int:
        """Number of pieces of a text; a blank is put before it, an empty text has none."""
        if not text:
            return 0
        text = text.replace(BLANK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return sum(map(self.__getitem__, text.split(" ")))
        # Each found word loses the blank that counting puts before it.
        return sum(self[w[1:]] for w in self.words(" " + text))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(read_pieces(path))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``.

    Null and empty texts have 0. Other columns pass through; one named ``n_tokens`` is replaced. Rows are worked
    on alone, so ties, repeated rows and empty tables need no rule. No rows move between tasks. ``path`` is a
    sentencepiece file present on every machine. A word needs memory of a few times its own size.
    """
    kept = [c for c in docs.columns if c not in (text, "n_tokens")]
    schema = docs.select(kept).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch.column("__text")], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], n], names=[*kept, "n_tokens"])

    return docs.select(*kept, docs[text].alias("__text")).mapInArrow(run, schema)
