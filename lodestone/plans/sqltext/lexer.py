"""Tokens of SQL text, with the quoting rules of a dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from lodestone.errors import InvalidArgs
from lodestone.plans.sqltext.dialects import Dialect


@dataclass(frozen=True)
class Token:
    kind: str  # word, ident (quoted), string, number, op, param, end
    text: str  # words as written; quoted ones without their quotes
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "op" else ""


CLOSE = {'"': '"', "`": "`", "[": "]"}
SKIP = re.compile(r"(?:\s+|--[^\n]*|/\*.*?\*/|#[^\n]*(?=\n|\Z))+", re.S)
PLAIN_SKIP = re.compile(r"(?:\s+|--[^\n]*|/\*.*?\*/)+", re.S)
NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
WORD = re.compile(r"[^\W\d]\w*(?:\$\w*)*|@@?\w+|\$\w+|[:?]\w+", re.U)
OPERATORS = ["<=>", "->>", "::", "||", "<=", ">=", "<>", "!=", "->", "=>", "==", "<<", ">>", "(", ")", ",", ".", ";", "+", "-", "*", "/", "%", "<", ">", "=", "[", "]", "{", "}", "?", "&", "|", "^", "~", "!", ":"]


def tokenize(sql: str, dialect: Dialect) -> list[Token]:
    out, i, n = [], 0, len(sql)
    skip = SKIP if dialect.name == "mysql" else PLAIN_SKIP
    while True:
        if m := skip.match(sql, i):
            i = m.end()
        if i >= n:
            out.append(Token("end", "", n, n))
            return out
        c = sql[i]
        subscript = c == "[" and out and out[-1].end == i and (out[-1].kind in ("word", "ident") or out[-1].text in (")", "]"))
        if c == "'" or (c == '"' and dialect.double_is_string):
            text, j = _quoted(sql, i, c, dialect.double_is_string)
            out.append(Token("string", text, i, j))
        elif c in CLOSE and c in dialect.reads and not subscript:
            text, j = _quoted(sql, i, CLOSE[c], False)
            out.append(Token("ident", text, i, j))
        elif m := NUMBER.match(sql, i):
            j = m.end()
            out.append(Token("number", m[0], i, j))
        elif m := WORD.match(sql, i):
            j = m.end()
            out.append(Token("param" if m[0][0] in "@$:?" else "word", m[0], i, j))
        else:
            op = next((o for o in OPERATORS if sql.startswith(o, i)), None)
            if op is None:
                raise InvalidArgs(f"unexpected character {c!r} at offset {i}", "check the SQL")
            j = i + len(op)
            out.append(Token("op", op, i, j))
        i = j


def _quoted(sql: str, i: int, close: str, backslash: bool) -> tuple[str, int]:
    out, j = [], i + 1
    while j < len(sql):
        if backslash and sql[j] == "\\" and j + 1 < len(sql):
            out.append(sql[j : j + 2] if sql[j + 1] not in "'\"\\" else sql[j + 1])
            j += 2
        elif sql[j] == close:
            if sql.startswith(close * 2, j):
                out.append(close)
                j += 2
            else:
                return "".join(out), j + 1
        else:
            out.append(sql[j])
            j += 1
    raise InvalidArgs(f"unterminated quote at offset {i}", "close the quote")
