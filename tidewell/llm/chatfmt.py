"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. The spans of the turns are found
from outside: the turns' prefixes are rendered one after the other, and what each output adds to the
one before is the turn's. Where an output doesn't begin with the one before, the template has
rewritten history, and that is told; everything is then taken from the last output. Within a turn, the text's place is found by rendering the turn
twice with two texts that differ in one letter: what stays the same before and after is the template's.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import sha256
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IllegalArgumentException

#: Strings with a meaning for the template; inside texts they are broken by a backslash.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\] (.*?) </s>\n", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string; none is left whole."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def instruct(turns: list[tuple[str, str]]) -> str:
    """The template of the registered query: each turn between its marks, its role between instruction marks."""
    return "".join(f"<s>[INST] {escape(role)} [/INST] {escape(text)} </s>\n" for role, text in turns)


def read_back(output: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(output)]


class Rendering:
    """Renders a conversation turn by turn, each behind all turns before it.

    `turn_local` declares that what the template makes of a turn depends on no other turn. Whole prefixes
    are then rendered for the first `proof` turns only; if none of them rewrote history, later turns are
    rendered behind the one before them, so a conversation of any length takes linear time and constant
    memory. A template found to rewrite history after that was declared wrongly, and is refused.
    """

    def __init__(self, template: Callable[[list], str], proof: int = 16, turn_local: bool = False):
        self.template, self.proof, self.turn_local = template, proof, turn_local
        self.turns: list[tuple[str, str]] = []
        self.before, self.n, self.rewrites = template([]), 0, False
        self.lead = self.before

    def add(self, role: str, text: str) -> tuple[str, int, int, bool]:
        """What the turn adds, where in that the (escaped) text stands, and whether the turn rewrote history."""
        if self.turn_local and self.n >= self.proof and not self.rewrites and len(self.turns) > 1:
            self.turns = self.turns[-1:]
            self.before = self.template(self.turns)
        out = self.template([*self.turns, (role, text)])
        rewrote = not out.startswith(self.before)
        if rewrote and self.n > len(self.turns):
            raise IllegalArgumentException("the template is not turn-local")
        kept = len(commonprefix([out, self.before])) if rewrote else len(self.before)
        one, two = (self.template([*self.turns, (role, letter)]) for letter in "ab")
        head = len(commonprefix([one, two]))
        tail = len(one) - head - 1
        self.turns.append((role, text))
        self.before, self.n, self.rewrites = out, self.n + 1, self.rewrites or rewrote
        return out[kept:], head - kept, len(out) - tail - kept, rewrote

    def places(self) -> list[tuple[int, int]]:
        """Where in the last output the texts of the turns stand, without those of turns that it doesn't show."""
        out, found = self.before, []
        for i, (role, _) in enumerate(self.turns):
            one, two = (self.template([*self.turns[:i], (role, letter), *self.turns[i + 1 :]]) for letter in "ab")
            if one != two:
                head = len(commonprefix([one, two]))
                found.append((head, len(out) - (len(one) - head - 1)))
        return found


SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites_history", pa.bool_())])


class _Digest:
    def __init__(self, template, turn_local):
        self.rendering = Rendering(template, turn_local=turn_local)
        self._empty(len(self.rendering.lead))

    def _empty(self, chars: int) -> None:
        self.turns, self.loss = sha256(), sha256()
        self.n = self.loss_chars = 0
        self.chars = chars

    def add(self, role: str, text: str) -> None:
        output, start, end, rewrote = self.rendering.add(role, text)
        if self.rendering.rewrites:
            return
        self.chars += len(output)
        for r, t in read_back(output):
            self._turn(r, t, [output[start:end]])

    def _turn(self, role: str, text: str, shown: list[str]) -> None:
        self.n += 1
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for masked in map(unescape, shown if role == "assistant" else []):
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))

    def _again(self) -> None:
        """All from the last output: what was read from those before it may have been rewritten."""
        out, places = self.rendering.before, self.rendering.places()
        self._empty(len(out))
        for m in _TURN.finditer(out):
            self._turn(unescape(m[1]), unescape(m[2]), [out[a:b] for a, b in places if m.start(2) <= a and b <= m.end(2)])

    def row(self, key) -> tuple:
        if self.rendering.rewrites:
            self._again()
        return key, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rendering.rewrites


def _format(template, turn_local):
    def run(batches):
        now, held = (), None
        for batch in batches:
            done = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if (key,) != now:
                    if held:
                        done.append(held.row(now[0]))
                    now, held = (key,), _Digest(template, turn_local)
                held.add(role or "", text or "")
            if done:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done), SCHEMA)], schema=SCHEMA)
        if held:
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip(held.row(now[0]), SCHEMA)], schema=SCHEMA)

    return run


def formatted(conversations: DataFrame, template: Callable[[list], str] = instruct, turn_local: bool = False) -> DataFrame:
    """One row per conversation of `conversations` (conv_id, turn, role, text), rows taken by turn (ties by role and text): conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history, all read back from the template's output.

    One shuffle by conv_id; inside a task rows stream in order and are hashed as they pass. Whole prefixes
    are rendered and compared, in time that grows with the square of a conversation's turns and the memory
    of one conversation, unless the caller declares with `turn_local` that the template makes each turn's
    part from that turn alone, as `instruct` does: then a conversation of any length needs the memory of
    two turns once its first turns are proved. Null role or text: empty. Null turn:
    first. Null conv_id: those rows are one conversation with a null id. Repeated rows are turns of
    their own. The query's planted conversation has the id -7: rows of the table with that id would be turns of it. An empty table: no rows. Other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(_format(template, turn_local), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
