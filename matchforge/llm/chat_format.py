"""Chat formatting into budgeted windows of whole turns, with a loss mask, and the way back.

A turn is written as `### <Role>: <text> </turn>` and a line end. Backslashes, and the marks `###` and `</turn>` inside a
text, are escaped with a backslash, so that texts can hold any marks and come back unchanged.

Windows: prefix sums of turn tokens choose the longest span of new turns that fits the budget. Every window starts with
the conversation's leading system turn, then repeats a limited history of earlier turns, then holds its new turns. Only
new assistant turns are under the loss mask; repeated ones are masked, so each assistant text is a target exactly once.

Conversations are streamed in sorted partitions; a task holds the turns of one window, never a whole conversation. One
conversation is read by one task, as its digest runs over all its turns in order.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm._common import small_batches
from matchforge.llm.tokens import default_tokenizer, encoder

BUDGET_TOKENS = 1024
HISTORY_TURNS = 2
WINDOWS = "conv_id long, window long, formatted string, loss_spans array<struct<start:int,end:int>>, new_turns array<boolean>, tokens long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, windows long"
_MARK = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
#: Ends a turn; inside a text the mark is escaped, so a backslash stands before it in place of the space.
_END = " </turn>\n"


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _role_out(role: str) -> str:
    return escape(role).replace(":", "\\:")


def _role_in(role: str) -> str:
    return unescape(role.replace("\\:", ":"))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as text, and the span of the escaped text with its end mark's space left out."""
    head = f"### {_role_out(role)}: "
    body = escape(text)
    return f"{head}{body} </turn>\n", len(head), len(head) + len(body)


def parse_turns(formatted: str):
    """(role, text, start, end) of each turn of a formatted window; start and end span the escaped text.

    A turn's end is found by search, so a turn of any length takes no memory beyond its text.
    """
    at = 0
    while at < len(formatted):
        m = _HEAD.match(formatted, at)
        end = formatted.find(_END, m.end()) if m else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        yield _role_in(m[1]), unescape(formatted[m.end() : end]), m.end(), end
        at = end + len(_END)


def count_tokens(role: str, text: str, codes) -> int:
    """Tokens of a turn as it is written. The vocabulary joins nothing across white space and a turn ends with a line end, so
    the tokens of turns add up to those of their window."""
    return len(codes.encode(format_turn(role, text)[0].encode("utf-8", "surrogatepass"))) // 2


class Windows:
    """Cuts one conversation's turns into windows as they arrive.

    `sums[i]` is the number of tokens of all turns before the i-th held one, so a span's tokens are a difference of two of
    them. Held are the turns that the next window may repeat and its new ones, never more.
    """

    def __init__(self, budget: int, history: int, codes):
        self.budget, self.history, self.codes = budget, history, codes
        self.turns, self.sums, self.begin, self.number = [], [0], 0, 0
        self.system, self.started = None, False

    def add(self, role: str, text: str) -> list:
        out, n = [], count_tokens(role, text, self.codes)
        if not self.started and role == "system":
            self.system = (role, text, n)
        self.started = True
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + n)
        if len(self.turns) - 1 > self.begin and self._fixed() + self.sums[-1] - self.sums[self._from()] > self.budget:
            out = self.close(len(self.turns) - 1)
        return out

    def _retained(self):
        """The system turn if later windows repeat it: where it leaves half of the budget to the others."""
        return self.system if self.number and self.system and 2 * self.system[2] <= self.budget else None

    def _fixed(self) -> int:
        return self._retained()[2] if self._retained() else 0

    def _from(self) -> int:
        """The first turn of the history: at most `history` turns that leave half of the budget to the system turn and new turns."""
        at = self.begin
        while at > 0 and self.begin - at < self.history and self._fixed() + self.sums[self.begin] - self.sums[at - 1] <= self.budget // 2:
            at -= 1
        return at

    def close(self, end: int | None = None) -> list:
        """The window of the new turns before `end`."""
        end = len(self.turns) if end is None else end
        if end == self.begin:
            return []
        first, system = self._from(), self._retained()
        tokens = self._fixed() + self.sums[end] - self.sums[first]
        shown = ([system[:2]] if system else []) + self.turns[first:end]
        repeated = len(shown) - (end - self.begin)
        parts, spans, at = [], [], 0
        for i, (role, text) in enumerate(shown):
            turn, start, stop = format_turn(role, text)
            if i >= repeated and role == "assistant":
                spans.append({"start": at + start, "end": at + stop})
            parts.append(turn)
            at += len(turn)
        row = (self.number, "".join(parts), spans, [False] * repeated + [True] * (end - self.begin), tokens)
        # The system turn that later windows repeat anyway is never part of their history.
        keep = max(end - self.history, 1 if self.number == 0 and self.system else 0, 0)
        self.turns, self.sums, self.begin, self.number = self.turns[keep:], self.sums[keep:], end - min(keep, end), self.number + 1
        return [row]


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET_TOKENS, history: int = HISTORY_TURNS, tokenizer: str | None = None) -> DataFrame:
    """Windows of every conversation: conv_id, window, formatted, loss_spans (of the escaped text), new_turns, tokens.

    Turns come in the order of `turn` (null first), then role and text, so ties and repeated rows have one order. Null
    texts and roles are empty. Rows with a null conversation id form one conversation. A turn larger than the budget has
    a window of its own. A leading system turn opens every window if it takes no more than half of the budget; a larger one
    stands in the first window only, so later windows keep to the budget. Partitions are sorted by conversation and window. An empty table gives an empty result.
    """
    small_batches(turns.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.bool_()), pa.int64()]
        names = ["conv_id", "window", "formatted", "loss_spans", "new_turns", "tokens"]

        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

        held, key, windows, codes = [], None, None, encoder(path)
        for batch in batches:
            for conv_id, role_, text_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if windows is None or conv_id != key:
                    if windows is not None:
                        held += [(key, *row) for row in windows.close()]
                    key, windows = conv_id, Windows(budget, history, codes)
                held += [(key, *row) for row in windows.add(role_, text_)]
                if len(held) >= 500:
                    yield batch_of(held)
                    held = []
        if windows is not None:
            held += [(key, *row) for row in windows.close()]
        if held:
            yield batch_of(held)

    return dealt.mapInArrow(run, WINDOWS)


def read_digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read back from their text: counts and digests of turns and loss text.

    `windows` has to be dealt and sorted by conversation and window, as format_conversations returns it.
    """

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "windows"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        state = None

        def row():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6])

        for batch in batches:
            held = []
            for conv_id, formatted, spans, new in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if state is None or conv_id != state[0]:
                    if state is not None:
                        held.append(row())
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for fresh, (role, text, _, _) in zip(new, parse_turns(formatted), strict=True):
                    if fresh:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in spans:
                    target = unescape(formatted[span["start"] : span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode("utf-8", "surrogatepass"))
                state[5] += len(formatted)
                state[6] += 1
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row(), kinds)], names)

    return windows.mapInArrow(run, DIGESTS)
