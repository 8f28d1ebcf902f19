"""Object literals in scripts, as JSON.

Pages carry their data as JavaScript more often than as JSON: single quotes, bare names, trailing commas, escapes, comments. One
pass over the tokens of a script keeps a stack of open brackets. A bracket whose content is a literal becomes JSON text when
it closes; one that turns out to be code is let go, but what stands in it is still looked at. Nothing is read twice.
"""

from __future__ import annotations

import json
import re

# Fields that list variants, with the bracket of their values.
LISTS = {"OFFERS": "[", "product_variations": "[", "variations": "[", "variants": "[", "spConfig": "{"}
MARK = re.compile("|".join(LISTS))
# Brackets in each other that a literal may have; what reads the JSON gives up at more.
DEPTH = 400

_TOKEN = re.compile(
    r"""(?P<space>[\s\ufeff]+|//[^\n]*)
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\$]|\\.|\$(?!\{))*`)
    |(?P<number>(?:0[xX][0-9a-fA-F]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?![\w$]))
    |(?P<word>(?:[^\W\d]|\$)[\w$]*)
    |(?P<other>.)""",
    re.S | re.X,
)
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[A-Za-z]*")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\u2028": "", "\u2029": ""}
_WORDS = {
    "true": "true", "false": "false", "null": "null", "undefined": "null", "NaN": "null", "Infinity": "null", "True": "true", "False": "false", "None": "null",
}
_CLOSES = {"}": "{", "]": "[", ")": "("}


def _escaped(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    if code:
        return chr(int(code, 16)) if int(code, 16) <= 0x10FFFF else "\ufffd"
    return _PLAIN.get(m[4], m[4])


def text_of(token: str) -> str:
    """What a quoted token says. Halves of a pair join; a lone half, which no text may hold, is replaced."""
    said = token[1:-1]
    if "\\" in said:
        said = _ESCAPE.sub(_escaped, said)
        if any("\ud800" <= c <= "\udfff" for c in said):
            said = said.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return said


def number_of(token: str) -> str:
    """A number as JSON writes it, with its digits as they stand."""
    if token[:2] in ("0x", "0X"):
        return str(int(token, 16))
    whole, e, power = token.replace("E", "e").partition("e")
    front, dot, back = whole.partition(".")
    front = front.lstrip("0") or "0"
    return front + (f".{back}" if back else "") + (f"e{power}" if e else "")


class _Open:
    """An open bracket: what it holds so far, and the literals found inside it that list variants."""

    __slots__ = ("kind", "items", "fields", "key", "state", "sign", "found")

    def __init__(self, kind: str, literal: bool):
        self.kind = kind
        # What may come next: a name, a colon, a value, a comma; skip: the value is an expression; code: no literal.
        self.state = ("name" if kind == "{" else "value") if literal and kind != "(" else "code"
        self.items: list[str] = []
        self.fields: dict[str, str] = {}
        self.key, self.sign = "", ""
        self.found: list[str] = []

    def put(self, value: str) -> None:
        if self.kind == "[":
            self.items.append(value)
        else:
            self.fields[self.key] = value  # of two fields of one name the last one counts
        self.state, self.sign = "comma", ""

    def skip(self, begun: bool = False) -> None:
        """The value is an expression, or, if one has ``begun``, was only its beginning: no field, or null in a list."""
        if self.kind == "{":
            self.fields.pop(self.key, None)
        elif begun:
            self.items[-1] = "null"
        else:
            self.items.append("null")
        self.state, self.sign = "skip", ""

    def literal(self) -> str | None:
        """The whole as JSON, or None if it can't end here."""
        if self.state in ("code", "colon") or self.sign or (self.kind == "{" and self.state == "value"):
            return None
        if self.kind == "[":
            return f"[{','.join(self.items)}]"
        return "{" + ",".join([f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in self.fields.items()]) + "}"

    def lists(self) -> bool:
        return self.kind == "{" and any(self.fields.get(k, "")[:1] == bracket for k, bracket in LISTS.items())


def _scalar(frame: _Open, kind: str, token: str) -> None:
    """A string, number or word in a frame."""
    state = frame.state
    if state == "name":
        frame.key, frame.state = (text_of(token) if kind == "string" else token), "colon"
    elif state == "value":
        if kind == "string" and not frame.sign:
            frame.put(json.dumps(text_of(token), ensure_ascii=False))
        elif kind == "number" and frame.sign in ("", "+", "-"):
            frame.put(frame.sign.strip("+") + number_of(token))
        elif kind == "number" and frame.sign == "!" and token in ("0", "1"):  # short for true and false
            frame.put("true" if token == "0" else "false")
        elif kind == "word" and token in _WORDS and frame.sign in ("", "+", "-") and not (frame.sign and _WORDS[token] != "null"):
            frame.put(_WORDS[token])
        elif kind == "word" and token == "void" and not frame.sign:
            frame.sign = "void"
        elif kind == "number" and frame.sign == "void":
            frame.put("null")
        else:
            frame.skip()
    elif state == "comma":
        frame.skip(begun=True)
    elif state == "colon":
        frame.state = "code"


def _sign(frame: _Open, token: str) -> None:
    """Any other single character."""
    state = frame.state
    if state == "code":
        return
    if token == ";":
        frame.state = "code"
    elif token == ",":
        if state == "value" and frame.kind == "[" and not frame.sign:
            frame.items.append("null")  # a hole
        elif state not in ("comma", "skip"):
            frame.state = "code"
            return
        frame.state = "name" if frame.kind == "{" else "value"
    elif token == ":" and state == "colon":
        frame.state = "value"
    elif state == "value" and token in "+-!" and not frame.sign:
        frame.sign = token
    elif state == "value":
        frame.skip()
    elif state == "comma":
        frame.skip(begun=True)
    elif state != "skip":
        frame.state = "code"


def _let_go(stack: list[_Open], held: dict[str, int]) -> None:
    lost = stack.pop()
    held[lost.kind] -= 1
    stack[-1].found += lost.found
    stack[-1].state = "code"


def _close(stack: list[_Open], held: dict[str, int], token: str) -> None:
    """A closing bracket; brackets that were never closed inside it are let go. ``held`` counts the open ones by kind."""
    kind = _CLOSES[token]
    if not held[kind]:
        stack[-1].state = "code"
        return
    while stack[-1].kind != kind:
        _let_go(stack, held)
    frame = stack.pop()
    held[kind] -= 1
    parent = stack[-1]
    whole = frame.literal()
    parent.found += [whole] if whole is not None and frame.lists() else frame.found
    if parent.state == "value" and not parent.sign:
        if whole is not None:
            parent.put(whole)
        else:
            parent.skip()
    elif parent.state == "value":
        parent.skip()
    elif parent.state not in ("skip", "code"):
        parent.state = "code"


def scan(script: str) -> tuple[list[str], str | None]:
    """Literals that list variants themselves (the outer one of two in each other), and the script's value if it is one literal."""
    top = _Open("[", True)
    stack, held, at, before, end = [top], dict.fromkeys("{[(", 0), 0, "", len(script)
    comments = True
    while at < end:
        m = _TOKEN.match(script, at)
        kind, token = m.lastgroup, m[0]
        if token == "/":
            if comments and script.startswith("/*", at):
                stop = script.find("*/", at + 2)
                if stop >= 0:
                    at = stop + 2
                    continue
                comments = False
            if before in ("", "return") or before in "(,=:[!&|?{};+-*%<>~^":
                if p := _PATTERN.match(script, at):
                    kind, token, m = "other", "/", p
        at = m.end()
        if kind == "space":
            continue
        frame = stack[-1]
        if kind != "other":
            _scalar(frame, kind, token)
        elif token in "{[(":
            if frame.state == "comma":
                frame.skip(begun=True)
            stack.append(_Open(token, len(stack) <= DEPTH))
            held[token] += 1
        elif token in "}])":
            _close(stack, held, token)
        else:
            _sign(frame, token)
        before = token
    while len(stack) > 1:
        _let_go(stack, held)
    alone = top.items[0] if top.state == "comma" and len(top.items) == 1 else None
    return top.found, alone


def listings(script: str) -> list[str]:
    """Literals of a script that list variants themselves, as JSON; a script that names no such field isn't read."""
    return scan(script)[0] if MARK.search(script) else []


def to_json(text: str) -> str:
    """A text that is one literal as JSON; any other text as it is."""
    if text.lstrip()[:1] not in ("{", "["):
        return text
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        return scan(text)[1] or text
