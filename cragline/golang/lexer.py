"""Go source text to tokens, with the semicolons that line ends stand for."""

from __future__ import annotations

import re

KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
OPERATORS = "<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()
TOKEN = re.compile(
    r"(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*(?s:.*?)\*/)|(?P<name>[^\W\d]\w*)"
    r"|(?P<number>(?:0[xX](?:[0-9a-fA-F_]*\.?[0-9a-fA-F_]*)(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)i?)"
    r"|(?P<raw>`[^`]*`)|(?P<string>\"(?:[^\"\\\n]|\\[^\n])*\")|(?P<rune>'(?:[^'\\\n]|\\[^\n][^'\n]*)')|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + ")"
)
ENDERS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, "'": 39, '"': 34}


class SyntaxProblem(Exception):
    """Source text that is not Go."""


class Token:
    __slots__ = ("kind", "text", "line", "at")

    def __init__(self, kind: str, text: str, line: int, at: int):
        self.kind, self.text, self.line, self.at = kind, text, line, at


def number_kind(text: str) -> str:
    if text.endswith("i"):
        return "IMAG"
    if text[:2] in ("0x", "0X"):
        return "FLOAT" if "." in text or "p" in text or "P" in text else "INT"
    return "FLOAT" if any(c in text for c in ".eE") and text[:2] not in ("0b", "0B", "0o", "0O") else "INT"


def tokens(source: str) -> list[Token]:
    """All tokens but comments; a token's kind is its text for keywords and operators."""
    out: list[Token] = []
    line, at, ends, size = 1, 0, False, len(source)
    if source.startswith("﻿"):
        at = 1
    match = TOKEN.match
    while at < size:
        m = match(source, at)
        if m is None:
            raise SyntaxProblem(f"line {line}: unexpected {source[at]!r}")
        group, text, start = m.lastgroup, m.group(), at
        at = m.end()
        if group == "space":
            continue
        if group == "line" or group == "comment":
            breaks = text.count("\n")
            if ends and breaks:
                out.append(Token(";", "\n", line, start))
                ends = False
            line += breaks
            continue
        if group == "name":
            kind = text if text in KEYWORDS else "name"
            ends = kind == "name" or kind in ENDERS
        elif group == "op":
            kind = text
            ends = kind in ENDERS
        else:
            kind = {"number": "number", "raw": "STRING", "string": "STRING", "rune": "CHAR"}[group]
            if kind == "number":
                kind = number_kind(text)
                if at < size and (source[at].isalnum() or source[at] == "_"):
                    raise SyntaxProblem(f"line {line}: bad number {text!r}")
            ends = True
        out.append(Token(kind, text, line, start))
        line += text.count("\n")
    if ends:
        out.append(Token(";", "\n", line, size))
    out.append(Token("end", "", line, size))
    return out


def unquoted(lexeme: str) -> bytes | None:
    """The bytes a string literal stands for; None if its escapes are wrong."""
    if lexeme[0] == "`":
        return lexeme[1:-1].replace("\r", "").encode()
    body, out, i = lexeme[1:-1], bytearray(), 0
    while i < len(body):
        c = body[i]
        if c != "\\":
            out += c.encode()
            i += 1
            continue
        e = body[i + 1]
        if e in ESCAPES and e != "'":
            out.append(ESCAPES[e])
            i += 2
            continue
        width, base, skip = {"x": (2, 16, 2), "u": (4, 16, 2), "U": (8, 16, 2)}.get(e, (3, 8, 1))
        digits = body[i + skip : i + skip + width]
        allowed = "0123456789abcdefABCDEF" if base == 16 else "01234567"
        if len(digits) != width or any(d not in allowed for d in digits):
            return None
        value = int(digits, base)
        if e in "uU":
            if value > 0x10FFFF or 0xD800 <= value < 0xE000:
                return None
            out += chr(value).encode()
        elif value > 255:
            return None
        else:
            out.append(value)
        i += skip + width
    return bytes(out)
