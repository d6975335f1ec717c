"""Java."""

from __future__ import annotations

import re

from scanloom.llm.syntax.core import Bad, Flat, Grammar, Split, kind_of, word

P, B, C = 0, 1, 2
# roles of ( ), [ ] and { }
EXPR, ARGS, PARAMS, HEADER, TYPE, CAUGHT, NAMES, OPENED, NOTE = 1, 2, 4, 8, 16, 32, 64, 128, 256
EMPTY, INDEX = 1, 2
BLOCK, BODY, VALUES, CASES, ENUM = 1, 2, 4, 8, 16

# Reserved words; the primitive types; words that are reserved only in some places.
RESERVED = "abstract assert break case catch class continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp switch synchronized throw throws transient try volatile while".split()
PRIMITIVE = "boolean byte char double float int long short void".split()
SOFT = "record sealed permits yield".split()
W = {k: word(k) for k in RESERVED + SOFT}
SOFTS = "".join(W[k] for k in SOFT)
NAME = "a" + SOFTS
MODIFIERS = "".join(W[k] for k in "abstract final native private protected public static strictfp synchronized transient volatile default sealed".split())
LOCAL = "".join(W[k] for k in "final abstract static strictfp".split())
KINDS = "".join(W[k] for k in "class interface enum".split())


class Cursor(Flat):
    __slots__ = ()

    # types
    def type(self) -> None:
        self.notes()
        if not self.take("p"):
            self.need(NAME)
            if self.next_is("<"):
                self.type_args()
            while self.next_is(".") and self.after() and self.after() in NAME:
                self.i += 2
                if self.next_is("<"):
                    self.type_args()
        while self.group(B, EMPTY):
            pass

    def type_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            if self.take("?"):
                if self.take(W["extends"] + "\x02"):
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_params(self) -> None:
        self.need("<")
        while True:
            self.need(NAME)
            if self.take(W["extends"]):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.need(">")

    def types(self) -> None:
        self.type()
        while self.take(",&"):
            self.type()

    def notes(self) -> None:
        while self.next_is("@") and self.after() != W["interface"]:
            self.i += 1
            self.qualified()
            self.group(P, NOTE | ARGS | EXPR)

    def qualified(self) -> None:
        self.need(NAME)
        while self.next_is(".") and self.after() and self.after() in NAME:
            self.i += 2

    # expressions
    def exprs(self) -> None:
        self.expr()

    def lambda_head(self) -> None:
        if not self.take(NAME):
            self.need_group(P, PARAMS | NAMES)
        self.need("⇒")

    def expr(self) -> None:
        c = self.at()
        if c and (c in NAME or self.is_group(P, PARAMS | NAMES)) and self.after() == "⇒":
            self.lambda_head()
            if not self.group(C, BLOCK):
                self.expr()
            return
        self.binary()
        if self.take("?"):
            self.expr()
            self.need(":")
            self.expr()
        elif self.take("=æ"):
            self.expr()

    def binary(self) -> None:
        self.unary()
        while True:
            c = self.at()
            if c == "":
                return
            if c == W["instanceof"]:
                self.i += 1
                self.take(W["final"])
                self.type()
                if not self.take(NAME):
                    self.group(P, PARAMS)
                continue
            if c == ">":
                while self.take(">"):
                    pass
                self.take("=")
            elif c in "·-<&|*":
                self.i += 1
            else:
                return
            self.unary()

    def unary(self) -> None:
        while self.take("!-±"):
            pass
        if self.is_group(P, TYPE):
            nxt = self.after()
            if nxt and (nxt in "a0s!p" + SOFTS + W["new"] + W["switch"] or kind_of(nxt) == P):
                i = self.i
                self.i += 1
                try:
                    if nxt in NAME and self.after() == "⇒":
                        self.expr()
                    else:
                        self.unary()
                    return
                except Bad:
                    self.i = i
        self.chain()
        self.take("±")

    def chain(self) -> None:
        self.primary()
        while True:
            c = self.at()
            if c == ".":
                self.i += 1
                if self.next_is("<"):
                    self.type_args()
                if self.take(W["new"]):
                    self.creation()
                    continue
                if not self.take(NAME + W["class"]):
                    raise Bad
                self.group(P, ARGS)
            elif c == "∷":
                self.i += 1
                if self.next_is("<"):
                    self.type_args()
                self.need(NAME + W["new"])
            elif not self.group(B, INDEX):
                return

    def creation(self) -> None:
        self.notes()
        if not self.take("p"):
            self.qualified()
            if self.next_is("<"):
                self.type_args()
        if self.group(P, ARGS):
            self.group(C, BODY)
            return
        sized = False
        while self.group(B, INDEX):
            sized = True
        empty = False
        while self.group(B, EMPTY):
            empty = True
        if not sized:
            if not empty:
                raise Bad
            self.need_group(C, VALUES)

    def generic_ref(self) -> None:
        self.type()
        if self.take("."):
            self.need(W["class"])
        elif not self.next_is("∷"):
            raise Bad

    def primary(self) -> None:
        c = self.at()
        if c == "":
            raise Bad
        if c == W["new"]:
            self.i += 1
            self.creation()
        elif c == W["switch"]:
            self.i += 1
            self.need_group(P, EXPR)
            self.need_group(C, CASES)
        elif c == "p":
            self.generic_ref()
        elif c in NAME:
            if self.after() == "<" or self.after() == chr(0xE000 + (B << 9) + EMPTY):
                if self.attempt(self.generic_ref):
                    return
            self.i += 1
            self.group(P, ARGS)
        elif c in "0s":
            self.i += 1
        elif not self.group(P, EXPR):
            raise Bad

    def value(self) -> None:
        if not self.group(C, VALUES):
            self.expr()

    # statements
    def locals(self, header: bool = False) -> None:
        while self.next_is(W["final"] + "@"):
            if not self.take(W["final"]):
                self.notes()
        self.type()
        self.declarators()

    def declarators(self) -> None:
        while True:
            self.need(NAME)
            while self.group(B, EMPTY):
                pass
            if self.take("="):
                self.value()
            if not self.take(","):
                return

    def local_statement(self) -> None:
        self.locals()
        self.need(";")

    def yield_statement(self) -> None:
        self.need(W["yield"])
        self.expr()
        self.need(";")

    def statement(self) -> None:
        c = self.at()
        if c == "":
            raise Bad
        if c == ";" or self.is_group(C, BLOCK):
            self.i += 1
        elif c == W["if"]:
            self.i += 1
            self.need_group(P, EXPR)
            self.statement()
            if self.take(W["else"]):
                self.statement()
        elif c == W["for"]:
            self.i += 1
            self.need_group(P, HEADER)
            self.statement()
        elif c == W["while"]:
            self.i += 1
            self.need_group(P, EXPR)
            self.statement()
        elif c == W["do"]:
            self.i += 1
            self.statement()
            self.need(W["while"])
            self.need_group(P, EXPR)
            self.need(";")
        elif c == W["try"]:
            self.i += 1
            opened = self.group(P, OPENED)
            self.need_group(C, BLOCK)
            caught = opened
            while self.take(W["catch"]):
                self.need_group(P, CAUGHT)
                self.need_group(C, BLOCK)
                caught = True
            if self.take(W["finally"]):
                self.need_group(C, BLOCK)
            elif not caught:
                raise Bad
        elif c == W["switch"] and self.attempt(self.switch):
            pass
        elif c == W["synchronized"]:
            self.i += 1
            self.need_group(P, EXPR)
            self.need_group(C, BLOCK)
        elif c == W["return"]:
            self.i += 1
            if not self.next_is(";"):
                self.expr()
            self.need(";")
        elif c == W["throw"]:
            self.i += 1
            self.expr()
            self.need(";")
        elif c == W["break"] or c == W["continue"]:
            self.i += 1
            self.take(NAME)
            self.need(";")
        elif c == W["assert"]:
            self.i += 1
            self.expr()
            if self.take(":"):
                self.expr()
            self.need(";")
        elif c == W["yield"] and self.attempt(self.yield_statement):
            pass
        elif c in NAME and self.after() == ":":
            self.i += 2
            self.statement()
        elif (c in LOCAL + KINDS + "@" + W["record"]) and self.attempt(self.type_decl):
            pass
        elif (c in NAME or c in "p@" or c == W["final"]) and self.attempt(self.local_statement):
            pass
        else:
            i = self.i
            self.expr()
            # only calls, creations, assignments and steps stand alone
            last = self.s[self.i - 1]
            body = self.s[i : self.i]
            if not (kind_of(last) == P or "=" in body or "æ" in body or "±" in body or W["new"] in body or W["switch"] in body):
                raise Bad
            self.need(";")

    def switch(self) -> None:
        self.need(W["switch"])
        self.need_group(P, EXPR)
        self.need_group(C, CASES)

    def cases(self) -> None:
        while self.at() != "":
            if self.take(W["case"]):
                while True:
                    if not self.take(W["default"]) and not self.attempt(self.pattern):
                        self.binary()
                    if not self.take(","):
                        break
            else:
                self.need(W["default"])
            if self.take("⇒"):
                if self.next_is(W["throw"]):
                    self.statement()
                elif not self.group(C, BLOCK):
                    self.expr()
                    self.need(";")
                continue
            self.need(":")
            while self.at() not in ("", W["case"], W["default"]):
                self.statement()

    def pattern(self) -> None:
        self.type()
        if not self.group(P, PARAMS):
            self.need(NAME)
        if self.next_is("a"):
            self.i += 1
            self.expr()
        if not self.next_is(":⇒,"):
            raise Bad

    # declarations
    def modifiers(self) -> None:
        while True:
            if self.next_is(MODIFIERS) and not (self.next_is(W["default"]) and self.after() == ":"):
                self.i += 1
            elif self.next_is("@") and self.after() != W["interface"]:
                self.notes()
            elif self.next_is("a") and self.after() == "-":  # non-sealed
                self.i += 2
                self.need(W["sealed"])
            else:
                return

    def type_decl(self) -> None:
        self.modifiers()
        self.take("@")
        c = self.at()
        if c and c in KINDS or c == W["record"]:
            self.i += 1
        else:
            raise Bad
        self.need(NAME)
        if self.next_is("<"):
            self.type_params()
        if c == W["record"]:
            self.need_group(P, PARAMS)
        while self.take(W["extends"] + W["implements"] + W["permits"]):
            self.types()
        self.need_group(C, ENUM if c == W["enum"] else BODY)

    def member(self) -> None:
        if self.take(";") or self.group(C, BLOCK):
            return
        if self.next_is(W["static"]) and kind_of(self.after()) == C:
            self.i += 1
            self.need_group(C, BLOCK)
            return
        if self.attempt(self.type_decl):
            return
        self.modifiers()
        if self.next_is("<"):
            self.type_params()
        if self.next_is(NAME) and kind_of(self.after()) == P:
            self.i += 1
        elif self.next_is(NAME) and kind_of(self.after()) == C:  # compact constructor
            self.i += 1
            self.need_group(C, BLOCK)
            return
        else:
            self.type()
            if kind_of(self.after()) == P:
                self.need(NAME)
            else:
                self.declarators()
                self.need(";")
                return
        self.need_group(P, PARAMS)
        while self.group(B, EMPTY):
            pass
        if self.take(W["throws"]):
            self.types()
        if not self.group(C, BLOCK):
            if self.take(W["default"]):
                self.value()
            self.need(";")

    def enum_body(self) -> None:
        while self.at() not in ("", ";"):
            self.notes()
            self.need(NAME)
            self.group(P, ARGS)
            self.group(C, BODY)
            if not self.take(","):
                break
        if self.take(";"):
            while self.at() != "":
                self.member()

    def unit_item(self) -> None:
        if self.take(";"):
            return
        i = self.i
        self.notes()
        if self.take(W["package"]):
            self.qualified()
            self.need(";")
        elif self.take(W["import"]):
            self.take(W["static"])
            self.qualified()
            if self.take("."):
                self.need("*")
            self.need(";")
        else:
            self.i = i
            self.type_decl()

    # parts of groups
    def param(self) -> None:
        while self.next_is(W["final"] + "@"):
            if not self.take(W["final"]):
                self.notes()
        self.type()
        self.take("…")
        if not (self.take(NAME) or self.at() == ""):
            raise Bad
        while self.take("."):
            self.need(NAME)
        while self.group(B, EMPTY):
            pass

    def params(self) -> None:
        while True:
            self.param()
            if self.s[self.i - 1] not in NAME and not self.is_group(B, EMPTY) and not self.i == self.n:
                raise Bad
            if not self.take(","):
                return

    def caught(self) -> None:
        self.take(W["final"])
        self.type()
        while self.take("|"):
            self.type()
        self.need(NAME)

    def opened(self) -> None:
        while self.at() != "":
            if not self.attempt(self.resource):
                self.chain()
            if not self.take(";"):
                return

    def resource(self) -> None:
        self.locals()
        if not self.next_is(";") and self.at() != "":
            raise Bad

    def each(self) -> None:
        self.take(W["final"])
        self.notes()
        self.type()
        self.need(NAME)
        self.need(":")
        self.expr()

    def header(self) -> None:
        if self.attempt(self.each):
            return
        if not self.next_is(";") and not self.attempt(self.start):
            self.expr()
            while self.take(","):
                self.expr()
        self.need(";")
        if not self.next_is(";"):
            self.expr()
        self.need(";")
        if self.at() != "":
            self.expr()
            while self.take(","):
                self.expr()

    def start(self) -> None:
        self.locals()
        if not self.next_is(";"):
            raise Bad

    def cast(self) -> None:
        self.type()
        while self.take("&"):
            self.type()

    def note_args(self) -> None:
        while True:
            if self.next_is(NAME) and self.after() == "=":
                self.i += 2
            if self.next_is("@"):
                self.notes()
            else:
                self.value()
            if not self.take(","):
                return


class Java(Grammar):
    keywords = {k: W[k] for k in RESERVED + SOFT} | {k: "p" for k in PRIMITIVE} | {"super": "a"}
    number = re.compile(r"0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?[lLfFdD]?")
    lex = re.compile(
        r"[^\W\d][\w$]*+|\$[\w$]*+|(?:[^\w\"'/$.]|\.(?!\d))++"
        r"|//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[ \t]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))'"
        r"|\.?\d[\w.]*(?:(?<=[eEpP])[+-]\d\w*)?"
    )
    joins = (
        (">>>=", "æ"), ("...", "…"), ("<<=", "æ"), (">>=", "æ"), ("->", "⇒"), ("::", "∷"), ("==", "·"), ("!=", "·"), ("<=", "·"), ("&&", "·"), ("||", "·"), ("++", "±"), ("--", "±"),
        ("+=", "æ"), ("-=", "æ"), ("*=", "æ"), ("/=", "æ"), ("%=", "æ"), ("&=", "æ"), ("|=", "æ"), ("^=", "æ"), ("<<", "·"), ("+", "-"), ("~", "!"), ("/", "·"), ("%", "·"), ("^", "·"),
    )
    more = W["else"] + W["catch"] + W["finally"]
    loop = W["do"] + W["while"]

    def __init__(self) -> None:
        super().__init__()
        self.illegal = re.compile(r"[^a0sp()\[\]{}·æ…⇒∷±!\-*<>=?:;,.&|@" + "".join(W.values()) + "]")

    _char = re.compile(r"'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))'")

    def lent(self, cut: Split, text: str) -> bool | None:
        if '"""' in text:
            return False
        if cut.template or cut.broken or not all(map(self._char.fullmatch, cut.single)):
            return None
        if cut.apart:
            return False
        return None if "`" in cut.loose or "'" in cut.loose or '"' in cut.loose else True

    def classify(self, kind: int, s: str) -> int:
        whole = lambda rule, x: bool(self.judged(rule, x, lambda y: self.whole(Cursor, rule, y)))
        if kind == P:
            if s == "":
                return ARGS | PARAMS | NAMES | NOTE
            if ";" in s:
                return HEADER * whole("header", s) | OPENED * whole("opened", s)
            f = s.replace("0", "a").replace("s", "a")
            parts = f.split(",")
            roles = NAMES * all(len(x) == 1 and x in NAME for x in parts)
            if all(whole("expr", x) for x in parts):
                roles |= ARGS | EXPR * (len(parts) == 1)
            if whole("params", s):
                roles |= PARAMS
            if len(parts) == 1:
                roles |= TYPE * whole("cast", s) | CAUGHT * whole("caught", s)
                if ":" in s:
                    roles |= HEADER * whole("each", s)
                if "=" in s:
                    roles |= OPENED * whole("opened", s)
                elif roles & EXPR:
                    roles |= OPENED
            if "=" in s or "@" in s or kind_of(s[0]) == C:
                roles |= NOTE * whole("note_args", s)
            return roles
        if kind == B:
            return EMPTY if s == "" else INDEX * whole("expr", s)
        if s == "":
            return BLOCK | BODY | VALUES | CASES | ENUM
        roles = 0
        if ";" not in s:
            parts = s.split(",")
            if not parts[-1]:
                parts.pop()
            roles |= VALUES * all(whole("value", x) for x in parts)
        if s[0] in (W["case"], W["default"]):
            roles |= CASES * self.whole(Cursor, "cases", s)
        if s[0] in NAME + "@;":
            roles |= ENUM * self.whole(Cursor, "enum_body", s)
        roles |= BLOCK * self.series(s, "statement", Cursor, "statement", more=self.more, loop=self.loop)
        roles |= BODY * self.series(s, "member", Cursor, "member")
        return roles

    def file(self, s: str, whole: bool = True) -> None:
        if not self.series(s, "unit", Cursor, "unit_item", whole=whole):
            raise Bad
