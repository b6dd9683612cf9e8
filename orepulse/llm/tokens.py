"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton lists all vocabulary pieces that end at a character; dynamic programming carries the best score and its
number of pieces to every character. Ties go to the path whose last piece starts first, as the tokenizer does when it walks the text
from the left and replaces a path only by a strictly better one. Spaces become the word mark. A unit is a run of marks and the word that
follows; no piece spans the border before a run, so units are independent and their counts are remembered. A vocabulary with pieces
that do span such a border is counted over whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame

from orepulse.llm.common import per_batch

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer: an unknown character scores so much below the worst piece
MAX_REMEMBERED = 400_000  # units remembered per task; a full memory starts afresh
MAX_WORD = 200  # longer units are counted, not remembered
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")  # a run of marks and the word after it
ONE_MARK = re.compile(f"{MARK}[^{MARK}]*")  # the cut of a tokenizer that splits its text at every mark


def read_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The normal pieces of a sentencepiece model with their scores; control and byte pieces never match text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ]


class Counter(dict):
    """``counter[unit]``: number of pieces of a unit, worked out on first use.

    ``whole_runs`` keeps the spaces of a run together, as the tokenizer does; without it every mark starts a unit.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]], whole_runs: bool = False):
        super().__init__()
        self.unit = UNIT if whole_runs else ONE_MARK
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.apart = not whole_runs or not any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in vocabulary)
        if vocabulary:
            self.automaton.make_automaton()

    def __missing__(self, unit: str) -> int:
        count = self.pieces(unit)
        if len(unit) <= MAX_WORD:
            if len(self) >= MAX_REMEMBERED:
                self.clear()
            self[unit] = count
        return count

    def pieces(self, word: str) -> int:
        """Number of pieces on the best path; an unknown character counts as its bytes."""
        size = len(word)
        score, count = [0.0] + [None] * size, [0] * (size + 1)
        done = 0

        def close(end: int) -> None:
            """Offer the unknown step to the characters up to ``end``; it starts last, so it comes after all pieces."""
            nonlocal done
            while done < end:
                done += 1
                ch = word[done - 1]
                if ch not in self.single and score[done - 1] is not None:
                    value = score[done - 1] + self.unknown
                    if score[done] is None or value > score[done]:
                        score[done], count[done] = value, count[done - 1] + len(ch.encode("utf-8"))

        for last, (length, own) in self.automaton.iter(word) if len(self.automaton) else ():
            close(last)
            before = score[last + 1 - length]
            if before is not None:
                value = before + own
                if score[last + 1] is None or value > score[last + 1]:
                    score[last + 1], count[last + 1] = value, count[last + 1 - length] + 1
        close(size)
        return count[size]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if not marked.startswith(MARK):
            marked = MARK + marked
        return sum(map(self.__getitem__, self.unit.findall(marked))) if self.apart else self.pieces(marked)


def count_tokens(docs: DataFrame, vocabulary: Sequence[tuple[str, float]] | str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens`` for every row of ``docs``; null and empty texts have 0, rows that share an id are counted each for itself.

    ``vocabulary`` is a list of (piece, score) or the path of a sentencepiece model, read once on the driver.
    """
    pieces = read_vocabulary(vocabulary) if isinstance(vocabulary, str) else list(vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)  # the vocabulary's size does not depend on the data

    counters: list[Counter] = []  # one per task, made in the task

    def work(texts: list) -> list:
        if not counters:
            counters.append(Counter(shipped.value, whole_runs=True))
        return [[counters[0].text(t) for t in texts]]

    return per_batch(docs.select("doc_id", "text"), work, "n_tokens long")
