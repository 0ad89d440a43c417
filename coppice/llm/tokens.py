"""Token counts with the whole-token shortcut, for a piece-wise BPE model with byte fallback.

Offline, the vocabulary is examined once: no piece spans a word start (a blank mark after another sign), so a text's
tokens are those of its blank-led pre-tokens, each encoded alone; the line break occurs in no piece, so it never merges
and ends a pre-token as well. Each blank-led vocabulary string is then encoded
alone, and those proven to give exactly one token form the shortcut set. At run time a pre-token of that set counts
one; only the rest is merged, and remembered: up to ``KEPT`` of at most ``LONG`` signs, so that memory is bounded.

Defined cases: a null text is empty and has 0 bytes and 0 tokens; repeated rows are counted each; texts of any length
are counted whole; an empty table gives no rows; other columns, whatever their names, play no part. Special strings
inside texts are ordinary text, the library's default.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from coppice.llm.common import picked, release

BLANK = "▁"
LIMIT = 4096
#: Pre-tokens remembered by a worker (beyond that, it starts anew), and the length of the longest that is.
KEPT, LONG = 1 << 19, 64


class WholeTokens:
    """The proven facts about one model, and its counter. ``tokens(text)`` equals the library's count."""

    def __init__(self, path: str) -> None:
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in pieces):
            raise ValueError("a piece spans a word start: pre-tokens of this model aren't independent")
        if m.encode("  a", out_type=str)[-1] != BLANK + "a" or len(m.encode("  a")) == len(m.encode("a")):
            raise ValueError("the model drops blanks")
        #: Whether a line break is in no piece, so that it is a token (its byte) that parts its neighbours.
        self.breaks = not any("\n" in p for p in pieces) and m.encode("\n", out_type=str) == [BLANK, "<0x0A>"]
        led = [p[1:] for p in pieces if p[0] == BLANK and len(p) > 1 and BLANK not in p[1:]]
        self.whole = frozenset(w for w, ids in zip(led, m.encode(led, num_threads=1)) if len(ids) == 1)
        self.chunks = re.compile(f"\n[^{BLANK}\n]*|{BLANK}+[^{BLANK}\n]*" if self.breaks else f"{BLANK}+[^{BLANK}]*")
        self._anew()

    def _anew(self) -> None:
        self.kept: dict[str, int] = dict.fromkeys(self.whole, 1)
        self.kept[""] = 1  # a blank on its own

    def _merged(self, keys: list[str]) -> dict[str, int]:
        """Tokens of pre-tokens outside the shortcut set; a key is what follows the blank, or a break and what follows it."""
        counts = map(len, self.model.encode(keys, num_threads=1))
        return {k: n - (self.breaks and k[0] == "\n") for k, n in zip(keys, counts)}

    def keys(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        if text[0] == " " or text[-1] == " " or "  " in text or BLANK in text:  # runs of blanks merge among themselves
            found = self.chunks.findall(BLANK + text.replace(" ", BLANK))
            return [c if c[0] == "\n" else c[1:].replace(BLANK, " ") for c in found]
        return (text.replace("\n", " \n") if self.breaks else text).split(" ")

    def tokens(self, text: str) -> int:
        if not text:
            return 0
        keys = self.keys(text)
        counts = list(map(self.kept.get, keys))
        if None in counts:
            new = self._merged(list({k for k, c in zip(keys, counts) if c is None}))
            counts = [new[k] if c is None else c for k, c in zip(keys, counts)]
            short = {k: n for k, n in new.items() if len(k) <= LONG}
            if len(self.kept) + len(short) > KEPT:
                self._anew()
            self.kept.update(short if len(self.kept) + len(short) <= KEPT else {})
        return sum(counts)


_loaded: dict[str, WholeTokens] = {}


def counter(path: str) -> WholeTokens:
    if path not in _loaded:
        _loaded[path] = WholeTokens(path)
    return _loaded[path]


def count_tokens(df: DataFrame, model: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text. No shuffle."""
    docs = picked(df, doc_id=(doc_id, T.LongType()), text=(text, T.StringType()))

    def run(batches):
        whole = counter(model)
        for batch in batches:
            texts = batch.column(1)
            size, count = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                t = texts[i]
                if t.is_valid:
                    size[i] = t.as_buffer().size
                    count[i] = whole.tokens(t.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(count), pa.array(count > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
        release()

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
