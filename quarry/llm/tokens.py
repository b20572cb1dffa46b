"""Token counts of a BPE tokenizer by a finite-state transducer.

A token sequence is the greedy BPE encoding of its text exactly when each token
encodes to itself and each adjacent pair encodes to that pair, so the encoding
of a prefix has one possible last token.  A transducer state therefore holds,
for each suffix of the prefix that can still grow into a piece, the token that
ends where the suffix starts and how many tokens stand since then.  Reading a
character picks the one piece that now ends the prefix; the transition is
annotated with the tokens it emits (the change of the prefix's token count,
which is negative when a longer piece swallows earlier ones).  States and
transitions are compiled when first met and kept in bounded tables.

Where two adjacent characters stand in no piece, the transducer is back in its
start state whatever came before.  A chunk's state map is therefore a head (the
characters before its first such place, to be run from any entry state), a
count, and an exit state; maps compose associatively.  A prefix scan over a
text's chunks gives the count at the end of every chunk.  It goes from left to
right from the start state, so every prefix is a count and a state: a chunk
without a reset is run from the state before it, and no text is joined.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import bounded_batches

MODEL = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
CHUNK_CHARS = 1 << 14
MAX_STATES = 200_000
MAX_WORDS = 400_000
SPACE = "▁"


class State(dict):
    """Character -> the next state and the tokens emitted, compiled when first met."""

    __slots__ = ("borders", "machine")

    def __init__(self, borders, machine):
        self.borders, self.machine = borders, machine

    def __missing__(self, c):
        return self.machine._step(self, c)


class _Words(dict):
    """Counts of whole words (a space mark and what follows) from the start state.
    Of a full table, the words that were met since the table before are kept."""

    def __init__(self, machine):
        super().__init__()
        self.machine, self.older = machine, {}

    def __missing__(self, word):
        n = self.older.get(word)
        if n is None:
            n = self.machine.run(self.machine.start, SPACE + word)[1]
        if len(self) >= MAX_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[word] = n
        return n


class Transducer:
    """Compiled from ``pieces`` (piece -> score); unknown characters count one
    token for each UTF-8 byte."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        self.bigrams = {p[k:k + 2] for p in pieces for k in range(len(p) - 1)}
        self.spaces_reset = not any(b[0] != SPACE and b[1] == SPACE for b in self.bigrams)
        self.start_borders = (("", None, 0),)
        self.stable: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = _Words(self)
        self._fresh()

    def _fresh(self):
        self.states = {}
        self.start = self._state(self.start_borders)

    def _state(self, borders) -> State:
        s = self.states.get(borders)
        if s is None:
            s = self.states[borders] = State(borders, self)
        return s

    def merged(self, text: str) -> list[str]:
        """Greedy merges by score, leftmost first: defines what the machine computes."""
        symbols = list(text)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                score = self.pieces.get(symbols[k] + symbols[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _ends(self, last: str | None, piece: str) -> bool:
        ok = self.stable.get(piece)
        if ok is None:
            ok = self.stable[piece] = len(self.merged(piece)) == 1
        if not ok or last is None:
            return ok
        ok = self.pairs.get((last, piece))
        if ok is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            ok = self.pairs[last, piece] = self.merged(last + piece) == [last, piece]
        return ok

    def _step(self, state: State, c: str) -> tuple[State, int]:
        if len(self.states) > MAX_STATES:
            self._fresh()
        borders = state.borders
        last = borders[-1][1]
        if c not in self.pieces:
            out = self._state(self.start_borders), len(c.encode("utf-8", "surrogatepass"))
        else:
            if last is not None and last[-1] + c not in self.bigrams:
                borders = self.start_borders
            for b, before, since in borders:
                if b + c in self.pieces and self._ends(before, b + c):
                    piece, emitted = b + c, 1 - since
                    break
            else:
                raise AssertionError("no piece ends here")
            grown = [(b + c, before, since + emitted) for b, before, since in borders if b + c in self.prefixes]
            out = self._state((*grown, ("", piece, 0))), emitted
        state[c] = out
        return out

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text`` and the tokens emitted."""
        total = 0
        for c in text:
            state, n = state[c]
            total += n
        return state, total

    # ------------------------------------------------------ chunk state maps

    def chunk_map(self, chunk: str):
        """``(head, count, exit)``; count and exit are None if the chunk holds
        no reset, and its map is then its head run from the entry state."""
        at = self._first_space(chunk) if self.spaces_reset else -1
        if at < 0:
            at = self._first_reset(chunk)
            return (chunk, None, None) if at < 0 else (chunk[:at], *self._slow(chunk[at:]))
        words = chunk[at + 1:].split(SPACE)
        tail = words.pop()
        if "" in words:  # runs of space marks are one unit with the next word
            return chunk[:at], *self._slow(chunk[at:])
        count = sum(map(self.words.__getitem__, words))
        state, more = self.run(self.start, SPACE + tail)
        return chunk[:at], count + more, state

    def _slow(self, text: str):
        state, total = self.run(self.start, text)
        return total, state

    @staticmethod
    def _first_space(chunk: str) -> int:
        """The first space mark after another character."""
        at = chunk.find(SPACE)
        while at == 0 or at > 0 and chunk[at - 1] == SPACE:
            at = chunk.find(SPACE, at + 1)
        return at

    def _first_reset(self, chunk: str) -> int:
        """The first character that stands in no piece with the one before it;
        a character that is no piece stands in none."""
        for k in range(1, len(chunk)):
            if chunk[k - 1:k + 1] not in self.bigrams:
                return k
        return -1

    def compose(self, a, b):
        """The map of a followed by b."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        state, more = self.run(a[2], b[0])
        if b[1] is None:
            return a[0], a[1] + more, state
        return a[0], a[1] + more + b[1], b[2]

    def prefix_scan(self, maps):
        """Inclusive scan from the start state.  Each prefix has an empty head,
        a count and a state, so its size is bounded and each head is run once."""
        prefixes = accumulate(maps, self.compose, initial=("", 0, self.start))
        next(prefixes)
        return prefixes

    def _prefixes(self, text: str, chunk_chars: int):
        marked = SPACE + text.replace(" ", SPACE)
        return self.prefix_scan(self.chunk_map(marked[k:k + chunk_chars])
                                for k in range(0, len(marked), chunk_chars))

    def counts(self, text: str, chunk_chars: int = CHUNK_CHARS) -> list[int]:
        """The token count at the end of each chunk of a text."""
        return [count for _, count, _ in self._prefixes(text, chunk_chars)] if text else [0]

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        """The token count of a text; only the last prefix is held."""
        n = 0
        if text:
            for _, n, _ in self._prefixes(text, chunk_chars):
                pass
        return n


_compiled: dict[str, Transducer] = {}


def load_transducer(model: str = MODEL) -> Transducer:
    """Compile the transducer of a sentencepiece BPE model once per process."""
    if model not in _compiled:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(len(sp))
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        probe = "  ﬁ Å 　x\t"
        if sp.normalize(probe).replace(SPACE, " ") != " " + probe:
            raise ValueError(f"{model} normalises texts; this compiler expects an identity normaliser")
        singles = {p for p in pieces if len(p) == 1}
        if any(c not in singles for p in pieces for c in p):
            raise ValueError(f"{model} has a piece with a character that is no piece itself")
        _compiled[model] = Transducer(pieces)
    return _compiled[model]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
                 limit: int = TOKEN_LIMIT, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row.

    Null and empty texts have no bytes and no tokens; null and repeated ids are
    returned as they come, an empty table gives an empty table, other columns
    are not read.  A text is never cut: it is counted in chunks of
    ``chunk_chars``, so a long one needs little memory beyond itself.  One scan,
    no shuffle.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(text_col).cast("binary")
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit(b"")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        machine = load_transducer(model)
        for b in batches:
            sizes, tokens = [], []
            for t in b.column(1):
                raw = t.as_py()
                sizes.append(len(raw))
                tokens.append(machine.count(raw.decode("utf-8", "replace"), chunk_chars))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
