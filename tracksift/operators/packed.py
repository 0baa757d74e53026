"""Several values packed in one field, split by a parsing expression grammar.

    field     <- spacing slots spacing !.
    slots     <- slot (sep slot)*
    slot      <- spacing (quoted after / bracketed after / bare / nothing) spacing
    quoted    <- '"' ('""' / !'"' .)* '"'  /  the same with single quotes
    bracketed <- '[' slots ']' / '(' slots ')' / '{' slots '}'
    bare      <- (!sep !close .)+            close: that of the bracket around
    after     <- spacing &(sep / close / !.)
    sep       <- '<SEP>' / [,;|/] / tab / line break / ' & ' / ' and ' / spaces where allowed

Alternatives are tried in this order and the first that fits wins; a quote or
bracket that is never closed, or after which neither a separator nor an end
follows, makes its alternative fail, and the parser goes back and reads the slot
as bare, with an error flag. The values of a bracketed slot follow each other
like others; brackets may be nested. Each field is parsed on its own, so this is a narrow
operation without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracksift.functions.arrow import map_partition

_SPACING = re.compile(r"[ \u00a0]*")
_QUOTED = {q: re.compile(f"{q}((?:{q}{q}|[^{q}])*){q}", re.S) for q in "\"'"}
_BRACKETS = {"[": "]", "(": ")", "{": "}"}
_SEP = r"<\s*SEP\s*>|[,;|/\t\r\n]|[ \u00a0]+(?:&|and|und)[ \u00a0]+"


#: Brackets within brackets that are parsed; deeper ones are read as bare.
DEPTH = 50


class Grammar:
    """Separators compiled for one kind of field; ``blanks`` says whether
    spaces between bare values separate them too."""

    def __init__(self, blanks: bool):
        sep = _SEP + (r"|[ \u00a0]+" if blanks else "")
        self.sep = re.compile(sep, re.I)
        # a bare value ends before a separator; spaces before that are spacing
        self.bare = {close: re.compile(rf"(?:(?!{sep}){char})+", re.I | re.S) for close, char in (("", "."), ("]", r"[^\]]"), (")", "[^)]"), ("}", "[^}]"))}

    def _sep_at(self, s: str, i: int) -> int:
        """End of the separator (with spacing) at ``i``; -1 if there is none."""
        j = _SPACING.match(s, i).end()
        for at in (j, i):
            m = self.sep.match(s, at)
            if m:
                return m.end()
        return -1

    def _after(self, s: str, i: int, close: str) -> bool:
        j = _SPACING.match(s, i).end()
        return j >= len(s) or s[j] == close or self._sep_at(s, i) >= 0

    def _quoted(self, s: str, i: int, close: str) -> tuple[str, int] | None:
        rule = _QUOTED.get(s[i])
        m = rule.match(s, i) if rule else None
        if not m or not self._after(s, m.end(), close):
            return None
        return m.group(1).replace(s[i] * 2, s[i]).strip(), m.end()

    def _bracketed(self, s: str, i: int, close: str, depth: int, failed: set[int]) -> tuple[list[tuple[str, bool]], int] | None:
        own = _BRACKETS.get(s[i])
        if own is None or depth >= DEPTH or i in failed:
            return None
        if s.find(own, i + 1) >= 0:
            values, end = self._slots(s, i + 1, own, depth + 1, failed)
            if end < len(s) and self._after(s, end + 1, close):
                return values, end + 1
        failed.add(i)
        return None

    def _slots(self, s: str, i: int, close: str, depth: int, failed: set[int]) -> tuple[list[tuple[str, bool]], int]:
        """((value, malformed) of each slot that holds a value, where the closing bracket or the end is)."""
        out, n = [], len(s)
        while True:
            i = _SPACING.match(s, i).end()
            if i >= n or s[i] == close:
                return out, i
            if read := self._quoted(s, i, close):
                value, i = read
                if value:
                    out.append((value, False))
            elif inner := self._bracketed(s, i, close, depth, failed):
                out += inner[0]
                i = inner[1]
            elif self.sep.match(s, i) is None:
                m = self.bare[close].match(s, i)
                value, i = m.group().strip(), m.end()
                if value:
                    out.append((value, '"' in value or value[0] in "'[({" or value[-1] in "'])}" and not any(x in value for x in "[({")))
            j = self._sep_at(s, i)
            i = j if j > i else max(i, _SPACING.match(s, i).end())

    def parse(self, s: str) -> list[tuple[str, bool]]:
        s = s.strip()
        values, _ = self._slots(s, 0, "", 0, set())
        own = _BRACKETS.get(s[:1])
        if own and s.endswith(own) and len(s) > 1 and values and values[0][0][0] == s[0]:
            # brackets around the whole that hold unequal ones: taken off, and all within is doubtful
            return [(v, True) for v, _ in self._slots(s[1:-1].strip(), 0, "", 0, set())[0]]
        return values


def packed_values(
    df: DataFrame,
    key: str,
    fields: dict[str, bool],
    clean: dict[str, Callable[[str], str]] | None = None,
) -> DataFrame:
    """Rows (key, field_name, pos, item_value, malformed), one per value.

    ``fields`` maps each column (string or array of strings) to whether blanks
    separate its values; ``clean`` may map a column to a function applied to
    each value, whose empty result leaves the slot out. Positions count values
    from 0 over all elements of an array; empty slots, NULLs and empty texts
    give no row; texts of any length are parsed whole. Repeated rows give
    repeated values. Columns beyond those named are ignored.
    """
    clean = clean or {}
    names = list(fields)
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType),
        T.StructField("field_name", T.StringType()), T.StructField("pos", T.LongType()),
        T.StructField("item_value", T.StringType()), T.StructField("malformed", T.BooleanType()),
    ])

    def split(rows: Iterator[tuple]) -> Iterator[tuple]:
        grammars = {name: Grammar(blanks) for name, blanks in fields.items()}
        for row in rows:
            for name, cell in zip(names, row[1:]):
                pos, fix = 0, clean.get(name)
                for text in [cell] if isinstance(cell, str) else cell or ():
                    for value, bad in grammars[name].parse(text or ""):
                        if not fix or (value := fix(value)):
                            yield row[0], name, pos, value, bad
                            pos += 1

    return map_partition(df.select(key, *names), split, schema)
