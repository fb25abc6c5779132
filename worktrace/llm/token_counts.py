"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each place of a word; dynamic programming carries
the best score and the number of pieces, never the pieces. The rules are those of the ``tokenizers`` library's Unigram
model after its Metaspace pre-tokenizer: white space ``' '`` begins a word; candidates of a place are tried from the
longest piece to the shortest and replace the best only if strictly better; neighbouring characters that no piece holds
fuse into one unknown piece, and with byte fallback count as their bytes. Every character of a piece has to be a piece
itself, as in all trained vocabularies; then unknown characters never compete with pieces.

The vocabulary is that of a public BPE file whose pieces are ordered by merge; as scores a unigram model needs log
probabilities, taken here by Zipf's law from that order (``zipf_vocabulary``). Any list of (piece, score) can be given.

Null and empty texts have 0 tokens; very long texts cost time in proportion; repeated rows are counted alike.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from worktrace.llm.common import Cache, slices, tokenizer_file

SPACE_MARK = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"


@lru_cache(maxsize=2)
def zipf_vocabulary(model: str = DEFAULT_MODEL) -> list[tuple[str, float]]:
    """(piece, log probability) in id order; control and byte pieces get a score below all others."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(model))
    size = sp.get_piece_size()
    plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) for i in range(size)]
    total = math.log(sum(1.0 / (r + 2.7) for r in range(sum(plain))))
    out, rank = [], 0
    for i in range(size):
        if plain[i]:
            out.append((sp.id_to_piece(i), -math.log(rank + 2.7) - total))
            rank += 1
        else:
            out.append((sp.id_to_piece(i), -100.0))
    return out


class PieceCounter:
    """Counts the pieces of words; ``vocabulary`` is a list of (piece, score), entry 0 the unknown piece."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known = {piece for piece, _ in vocabulary}
        self.bytes_known = byte_fallback and all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.characters = frozenset(piece for piece in self.known if len(piece) == 1)
        if any(not self.characters.issuperset(piece) for piece, _ in vocabulary if not piece.startswith("<")):
            raise ValueError("a piece holds a character that is not a piece")
        self.known_runs = Cache(self.count, 200_000)

    def count(self, word: str) -> int:
        if not self.characters.issuperset(word):
            return self.count_with_unknown(word)
        # The automaton reports the pieces of a place from the longest to the shortest.
        best = [0.0] + [-math.inf] * len(word)
        pieces = [0] * (len(word) + 1)
        for end, (length, score) in self.automaton.iter(word):
            end += 1
            score += best[end - length]
            if score > best[end]:
                best[end] = score
                pieces[end] = pieces[end - length] + 1
        return pieces[-1]

    def count_with_unknown(self, word: str) -> int:
        """No piece holds an unknown character, so that the runs between them stand alone."""
        total = 0
        for known, run in groupby(word, self.characters.__contains__):
            part = "".join(run)
            total += self.known_runs[part] if known else (len(part.encode()) if self.bytes_known else 1)
        return total


@lru_cache(maxsize=2)
def _cache(model: str) -> Cache:
    counter = PieceCounter(zipf_vocabulary(model))
    return Cache(lambda part: counter.count(SPACE_MARK + part))


def count_text(text: str | None, cache: Cache) -> int:
    """Pieces of a text: every space begins a word, and a text that begins without one is given one."""
    if not text:
        return 0
    parts = text.replace(SPACE_MARK, " ").split(" ")
    if parts[0] == "":
        parts = parts[1:]
    return sum(map(cache.__getitem__, parts))


def token_counts(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and n_tokens of every row of ``docs``."""

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches):
        cache = _cache(model)
        for batch in batches:
            for ids, texts in slices(batch):
                counts = [count_text(t, cache) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long")
