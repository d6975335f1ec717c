"""JavaScript (script or module) and TypeScript."""

from __future__ import annotations

import re

from scanloom.llm.syntax.core import ENDS_NL, Bad, Flat, Grammar, Split, kind_of, word

P, B, C = 0, 1, 2
# roles of ( ), [ ] and { }
EXPR, ARGS, PARAMS, HEADER, TYPE, CAUGHT = 1, 2, 4, 8, 16, 32
LIST, INDEX, PATTERN, TUPLE = 1, 2, 4, 8
BLOCK, OBJECT, CLASS, MEMBERS, NAMES, CASES, ENUM, DESTRUCT = 1, 2, 4, 8, 16, 32, 64, 128

# Reserved words and the contextual words with a grammar of their own.
RESERVED = "await break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof let new return static switch throw try typeof var void while with yield async of".split()
TYPED = "as satisfies interface type namespace module declare abstract readonly keyof infer is asserts unique public private protected override implements global out accessor".split()
W = {k: word(k) for k in RESERVED + TYPED}
# words that are names wherever no rule of their own fits
SOFT = "".join(W[k] for k in "async of static await yield let".split() + TYPED)
NAME = "a" + SOFT
KEYS = "".join(W.values())
MODIFIERS = "".join(W[k] for k in "static async readonly abstract public private protected override declare accessor".split())
LITERALS = "a0str" + SOFT


class Cursor(Flat):
    __slots__ = ()

    @property
    def ts(self) -> bool:
        return self.g.ts

    # expressions
    def exprs(self) -> None:
        self.assign()
        while self.take(","):
            self.assign()

    def arrow(self) -> None:
        if self.next_is(W["async"]) and self.after() and (self.after() in NAME + "<" or kind_of(self.after()) == P):
            self.i += 1
        if self.ts and self.next_is("<"):
            self.type_params()
        if not self.take(NAME):
            self.need_group(P, PARAMS)
            if self.ts and self.take(":"):
                self.type()
        self.need("⇒")

    def assign(self) -> None:
        c = self.at()
        if c and (c in NAME or c == "<" or self.is_group(P, PARAMS)):
            if self.attempt(self.arrow):
                if not self.group(C, BLOCK):
                    self.assign()
                return
        if c == W["yield"]:
            self.i += 1
            self.take("*")
            nxt = self.at()
            if nxt and nxt not in ",;:" and "\n" not in self.s[self.i - 1 : self.i + 1]:
                self.attempt(self.assign)
            return
        self.binary()
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign()
        elif self.take("=æ"):
            self.assign()

    def binary(self) -> None:
        self.unary()
        while True:
            c = self.at()
            if c == "":
                return
            if self.ts and c in (W["as"], W["satisfies"]) and self.s[self.i - 1] != "\n":
                self.i += 1
                if not self.take(W["const"]):
                    self.type()
                continue
            if c == ">":
                while self.take(">"):
                    pass
                self.take("=")
            elif c in "·*-<&|" or c in (W["in"], W["instanceof"]):
                self.i += 1
            else:
                return
            self.unary()

    def unary(self) -> None:
        while True:
            c = self.at()
            if c and (c in "!-±" or c in (W["typeof"], W["void"], W["delete"])):
                self.i += 1
            elif c == W["await"] and self.after() and self.after() not in ".,;)=·?:⇒":
                self.i += 1
            elif c == "<" and self.ts:
                self.i += 1
                self.type()
                self.need(">")
            else:
                break
        self.chain()
        if self.i < self.n and self.s[self.i] == "±":
            self.i += 1

    def chain(self) -> None:
        if self.take(W["new"]):
            if self.take("."):
                self.need("a")
            else:
                self.chain()
                return
        else:
            self.primary()
        while True:
            c = self.at()
            if c == "":
                return
            if c == "." or c == "‽":
                self.i += 1
                if c == "‽" and (self.group(P, ARGS) or self.group(B, INDEX)):
                    continue
                if not self.take("a#" + KEYS):
                    raise Bad
                continue
            if c == "t" or self.is_group(P, ARGS) or self.is_group(B, INDEX):
                self.i += 1
            elif c == "!" and self.ts and self.s[self.i - 1] != "\n":
                self.i += 1
            elif c == "<" and self.ts and self.attempt(self.type_call):
                pass
            else:
                return

    def type_call(self) -> None:
        self.type_args()
        if not (self.is_group(P, ARGS) or self.next_is("t")):
            raise Bad

    def primary(self) -> None:
        c = self.at()
        if c == "":
            raise Bad
        if c == W["async"] and self.after() == W["function"]:
            self.i += 1
            c = self.at()
        if c == W["function"]:
            self.i += 1
            self.take("*")
            self.take(NAME)
            self.callable()
            self.need_group(C, BLOCK)
        elif c == W["class"]:
            self.klass()
        elif c == W["import"]:
            self.i += 1
            if not self.group(P, ARGS):
                self.need(".")
                self.need("a")
        elif c in LITERALS or c == "#":
            self.i += 1
        elif not (self.group(P, EXPR) or self.group(B, LIST) or self.group(C, OBJECT)):
            raise Bad

    def callable(self) -> None:
        """Type parameters, parameters and result type."""
        if self.ts and self.next_is("<"):
            self.type_params()
        self.need_group(P, PARAMS)
        if self.ts and self.take(":"):
            self.type()

    def klass(self) -> None:
        self.need(W["class"])
        if self.at() != W["extends"] and self.at() != W["implements"]:
            self.take(NAME)
        if self.ts and self.next_is("<"):
            self.type_params()
        if self.take(W["extends"]):
            self.chain()
            if self.ts and self.next_is("<"):
                self.type_args()
        if self.ts and self.take(W["implements"]):
            self.types()
        self.need_group(C, CLASS)

    # types
    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type_args(self) -> None:
        self.need("<")
        self.types()
        self.need(">")

    def type_params(self) -> None:
        self.need("<")
        while True:
            self.take(W["const"])
            self.need(NAME)
            if self.take(W["extends"]):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
            if self.next_is(">"):
                break
        self.need(">")

    def type(self) -> None:
        self.take("|&")
        while True:
            self.type_term()
            if not self.take("|&"):
                break
        if self.take(W["extends"]):
            self.type()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def signature(self) -> None:
        self.take(W["new"])
        if self.next_is("<"):
            self.type_params()
        self.need_group(P, PARAMS)
        self.need("⇒")
        self.type()

    def type_term(self) -> None:
        while self.next_is("".join(W[k] for k in "keyof typeof readonly infer unique".split())) and self.after() and self.after() not in ",;>)=|&.":
            self.i += 1
        c = self.at()
        if c == "":
            raise Bad
        if (c == "<" or c == W["new"] or self.is_group(P, PARAMS)) and self.attempt(self.signature):
            return
        if c in (W["asserts"],) and self.after() and self.after() in NAME:
            self.i += 1
        if self.take("-"):
            self.need("0")
        elif self.take(NAME + W["void"]):
            while self.take("."):
                self.need(NAME + KEYS)
            if self.take(W["is"]):
                self.type()
                return
            if self.next_is("<"):
                self.type_args()
        elif self.take(W["import"]):
            self.need_group(P, ARGS)
            while self.take("."):
                self.need(NAME)
        elif not (self.take("0st") or self.group(P, TYPE) or self.group(B, TUPLE) or self.group(C, MEMBERS)):
            raise Bad
        while self.i < self.n and self.s[self.i] != "\n" and self.group(B, TUPLE):
            pass

    # statements
    def end(self) -> None:
        """; or a line end or the end of the text."""
        if self.i < self.n and self.s[self.i] == ";":
            self.i += 1
        elif self.i >= self.n:
            self.open_end = True
        elif self.s[self.i] != "\n" and self.s[self.i - 1] != "\n":
            self.at()
            if self.take(";"):
                return
            raise Bad

    def finish(self) -> None:
        if self.at() == "":
            self.open_end = True
        elif self.s[self.i] == ";":
            self.i += 1
        elif self.s[self.i - 1] != "\n":
            raise Bad

    def binding(self) -> bool:
        if self.take(NAME):
            return False
        if not (self.group(B, PATTERN) or self.group(C, DESTRUCT)):
            raise Bad
        return True

    def declarations(self, kind: str, header: bool = False, ambient: bool = False) -> None:
        while True:
            pattern = self.binding()
            typed = False
            if self.ts:
                self.take("!")
                typed = self.take(":")
                if typed:
                    self.type()
            if self.take("="):
                self.assign()
            elif (pattern or kind == W["const"] and not typed) and not header and not ambient:
                raise Bad
            if not self.take(","):
                return

    def statement(self) -> None:
        c = self.at()
        if c == "":
            raise Bad
        if c == ";":
            self.i += 1
        elif self.is_group(C, BLOCK):
            self.i += 1
        elif c in (W["var"], W["const"], W["let"]) and not (c == W["const"] and self.after() == W["enum"]):
            self.i += 1
            self.declarations(c)
            self.finish()
        elif c == W["function"] or c == W["async"] and self.after() == W["function"]:
            self.take(W["async"])
            self.i += 1
            self.take("*")
            self.need(NAME)
            self.callable()
            if not self.group(C, BLOCK):
                if not self.ts:
                    raise Bad
                self.finish()
        elif c == W["class"]:
            if not (self.after() and self.after() in NAME):
                raise Bad
            self.klass()
        elif c == W["if"]:
            self.i += 1
            self.need_group(P, EXPR)
            self.statement()
            if self.take(W["else"]):
                self.statement()
        elif c == W["for"]:
            self.i += 1
            self.take(W["await"])
            self.need_group(P, HEADER)
            self.statement()
        elif c == W["while"] or c == W["with"]:
            self.i += 1
            self.need_group(P, EXPR)
            self.statement()
        elif c == W["do"]:
            self.i += 1
            self.statement()
            self.need(W["while"])
            self.need_group(P, EXPR)
            self.take(";")
        elif c == W["return"]:
            self.i += 1
            if self.i < self.n and self.s[self.i] not in ";\n":
                self.exprs()
            self.finish()
        elif c == W["throw"]:
            self.i += 1
            self.exprs()
            self.finish()
        elif c == W["break"] or c == W["continue"]:
            self.i += 1
            if self.i < self.n and self.s[self.i] in NAME:
                self.i += 1
            self.finish()
        elif c == W["debugger"]:
            self.i += 1
            self.finish()
        elif c == W["try"]:
            self.i += 1
            self.need_group(C, BLOCK)
            caught = self.take(W["catch"])
            if caught:
                self.group(P, CAUGHT)
                self.need_group(C, BLOCK)
            if self.take(W["finally"]):
                self.need_group(C, BLOCK)
            elif not caught:
                raise Bad
        elif c == W["switch"]:
            self.i += 1
            self.need_group(P, EXPR)
            self.need_group(C, CASES)
        elif c == W["import"] and self.after() not in (".",) and kind_of(self.after()) != P:
            self.imports()
        elif c == W["export"]:
            self.exports()
        elif c == "@":
            self.decorators()
            self.statement()
        elif self.ts and c in KEYS and self.attempt(self.typed_statement):
            pass
        elif c in NAME and self.after() == ":":
            self.i += 1
            self.need(":")
            self.statement()
        elif kind_of(c) == C:  # no expression may begin a statement with a brace
            raise Bad
        else:
            self.exprs()
            self.finish()

    def decorators(self) -> None:
        while self.take("@"):
            self.chain()

    def typed_statement(self) -> None:
        c = self.at()
        self.i += 1
        if c == W["interface"]:
            self.need(NAME)
            if self.next_is("<"):
                self.type_params()
            if self.take(W["extends"]):
                self.types()
            self.need_group(C, MEMBERS)
        elif c == W["type"]:
            self.need(NAME)
            if self.next_is("<"):
                self.type_params()
            self.need("=")
            self.type()
            self.finish()
        elif c == W["enum"] or c == W["const"] and self.take(W["enum"]):
            self.need(NAME)
            self.need_group(C, ENUM)
        elif c in (W["namespace"], W["module"]):
            if not self.take("s"):
                self.need(NAME)
                while self.take("."):
                    self.need(NAME)
            if not self.group(C, BLOCK):
                self.finish()
        elif c == W["abstract"]:
            self.klass()
        elif c == W["declare"]:
            k = self.at()
            if self.take(W["global"]):
                self.need_group(C, BLOCK)
            elif k and k in (W["const"], W["let"], W["var"]):
                self.i += 1
                self.declarations(k, ambient=True)
                self.finish()
            elif k and k in "".join(W[x] for x in "function class interface type enum namespace module abstract".split()):
                self.statement()
            else:
                raise Bad
        else:
            raise Bad

    def imports(self) -> None:
        self.need(W["import"])
        if self.take("s"):
            self.finish()
            return
        if self.ts and self.next_is(W["type"]) and self.after() and self.after() not in ("=", ",", W["of"]):
            self.i += 1
        if self.take(NAME):
            if self.ts and self.take("="):
                self.exprs()
                self.finish()
                return
            if self.take(","):
                self.import_names()
        else:
            self.import_names()
        if not (self.at() == "f"):
            raise Bad
        self.i += 1
        self.need("s")
        self.finish()

    def import_names(self) -> None:
        if self.take("*"):
            self.alias()
        else:
            self.need_group(C, NAMES)

    def alias(self) -> None:
        if self.at() != W["as"]:
            raise Bad
        self.i += 1
        self.need(NAME + "s" + KEYS)

    def exports(self) -> None:
        self.need(W["export"])
        if self.take(W["default"]):
            c = self.at()
            if c == W["function"] or c == W["async"] and self.after() == W["function"]:
                self.primary()
            elif c == W["class"]:
                self.klass()
            elif self.ts and c in (W["interface"], W["abstract"]) and self.attempt(self.typed_statement):
                pass
            else:
                self.assign()
                self.finish()
            return
        if self.ts and self.take("="):
            self.exprs()
            self.finish()
            return
        if self.ts and self.next_is(W["type"]) and (kind_of(self.after()) == C or self.after() == "*"):
            self.i += 1
        if self.take("*"):
            if self.next_is(W["as"]):
                self.alias()
            if self.at() != "f":
                raise Bad
            self.i += 1
            self.need("s")
            self.finish()
        elif self.group(C, NAMES):
            if self.at() == "f":
                self.i += 1
                self.need("s")
            self.finish()
        else:
            c = self.at()
            if not c or c not in "@" + "".join(W[k] for k in "var let const function class async interface type enum namespace module abstract declare import".split()):
                raise Bad
            self.statement()

    # members and parts
    def member_name(self) -> None:
        self.take("#")
        if not (self.take("as0" + KEYS) or self.group(B, INDEX)):
            raise Bad

    def class_member(self) -> None:
        self.decorators()
        if self.take(";"):
            return
        if self.next_is(W["static"]) and kind_of(self.after()) == C:
            self.i += 1
            self.need_group(C, BLOCK)
            return
        ends = "=;:?!,<("
        while self.next_is(MODIFIERS) and self.after() and self.after() not in ends and kind_of(self.after()) != P:
            self.i += 1
        self.take("*")
        if self.next_is("g") and self.after() and self.after() not in ends and kind_of(self.after()) != P:
            self.i += 1
        if self.ts and self.is_group(B, TUPLE) and self.after() == ":":
            self.i += 2
            self.type()
            self.finish()
            return
        if not self.take("g"):
            self.member_name()
        if self.ts:
            self.take("?!")
        if self.is_group(P, PARAMS) or self.ts and self.next_is("<"):
            self.callable()
            if not self.group(C, BLOCK):
                if not self.ts:
                    raise Bad
                self.finish()
            return
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.assign()
        self.finish()

    def type_member(self) -> None:
        if self.take(";,"):
            return
        if self.is_group(P, PARAMS) or self.next_is("<"):
            self.callable()
        elif self.next_is(W["new"]) and kind_of(self.after()) == P:
            self.i += 1
            self.callable()
        else:
            self.take("-")
            while self.next_is(W["readonly"] + "g") and self.after() and self.after() not in ":?;,(" and kind_of(self.after()) != P:
                self.i += 1
            if self.is_group(B, TUPLE | INDEX):
                self.i += 1
            elif not self.take("g"):
                self.member_name()
            self.take("-")
            self.take("?")
            if self.is_group(P, PARAMS) or self.next_is("<"):
                self.callable()
            elif self.take(":"):
                self.type()
        if not self.take(","):
            self.finish()

    def prop(self) -> None:
        if self.take("…"):
            self.assign()
            return
        made = False
        while self.next_is(W["async"] + "g*") and self.after() not in ("", ":", ",", "=") and kind_of(self.after()) != P:
            self.i += 1
            made = True
        c = self.at()
        if not self.take("g"):
            self.member_name()
        if self.is_group(P, PARAMS) or self.ts and self.next_is("<"):
            self.callable()
            self.need_group(C, BLOCK)
        elif made:
            raise Bad
        elif self.take(":"):
            self.assign()
        elif not (c == "g" or c in NAME):
            raise Bad
        elif self.take("="):
            self.assign()

    def spread(self) -> None:
        self.take("…")
        self.assign()

    def param(self) -> None:
        self.decorators()
        while self.ts and self.next_is(MODIFIERS) and self.after() and self.after() in NAME:
            self.i += 1
        self.take("…")
        self.binding()
        if self.ts:
            self.take("?")
            if self.take(":"):
                self.type()
        if self.take("="):
            self.assign()

    def params(self) -> None:
        while self.at() != "":
            self.param()
            if not self.take(","):
                return

    def destruct(self) -> None:
        if self.take("…"):
            self.binding()
            return
        c = self.at()
        self.member_name()
        if self.take(":"):
            self.binding()
        elif c not in NAME:
            raise Bad
        if self.take("="):
            self.assign()

    def name_as(self) -> None:
        if self.next_is(W["type"]) and self.after() not in ("", W["as"]):
            self.i += 1
        self.need("as" + KEYS)
        if self.at() == W["as"]:
            self.alias()

    def enum_item(self) -> None:
        self.need("as" + KEYS)
        if self.take("="):
            self.assign()

    def tuple_item(self) -> None:
        self.take("…")
        if self.next_is(NAME) and self.after() in (":", "?"):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type()
        self.take("?")

    def mapped(self) -> None:
        self.need(NAME)
        self.need(W["in"])
        self.type()
        if self.take(W["as"]):
            self.type()

    def tuple_items(self) -> None:
        while self.at() != "":
            self.tuple_item()
            if not self.take(","):
                return

    def header(self) -> None:
        self.open_end = False
        c = self.at()
        if c and c in (W["var"], W["let"], W["const"]):
            self.i += 1
            self.declarations(c, header=True)
        elif c != ";":
            if self.attempt(self.of_target):
                return
            self.exprs()
        if self.take(W["of"] + W["in"]):
            self.exprs()
            return
        self.need(";")
        if self.at() != ";":
            self.exprs()
        self.need(";")
        if self.at() != "":
            self.exprs()

    def of_target(self) -> None:
        self.chain()
        self.need(W["of"])
        self.exprs()

    def cases(self) -> None:
        while self.at() != "":
            if self.take(W["case"]):
                self.exprs()
            else:
                self.need(W["default"])
            self.need(":")
            while self.at() not in ("", W["case"], W["default"]):
                self.statement()

    def caught(self) -> None:
        self.binding()
        if self.ts and self.take(":"):
            self.type()


class Script(Grammar):
    """JavaScript; with ``ts`` TypeScript."""

    lines_matter = True
    keywords = {k: W[k] for k in RESERVED} | {"as": W["as"], "from": "f", "get": "g", "set": "g"}
    lex = re.compile(
        r"[^\W\d][\w$]*+|\$[\w$]*+"
        r"|(?<=[=(,:\[!&|?{};])[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
        r"|(?<=\breturn)[ \t]*/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
        r"|(?:[^\w\"'`/$.=(,:\[!&|?{};]|\.(?!\d)|[=(,:\[!&|?{};](?![ \t]*/))++"
        r"|//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`"
        r"|\.?\d[\w.]*(?:(?<=[eE])[+-]\d\w*)?"
    )
    joins = (
        (">>>=", "æ"), ("...", "…"), ("===", "·"), ("!==", "·"), ("**=", "æ"), ("<<=", "æ"), (">>=", "æ"), ("&&=", "æ"), ("||=", "æ"), ("??=", "æ"),
        ("=>", "⇒"), ("==", "·"), ("!=", "·"), ("<=", "·"), (">=", "·"), ("&&", "·"), ("||", "·"), ("??", "·"), ("?.", "‽"), ("++", "±"), ("--", "±"),
        ("+=", "æ"), ("-=", "æ"), ("*=", "æ"), ("/=", "æ"), ("%=", "æ"), ("&=", "æ"), ("|=", "æ"), ("^=", "æ"), ("**", "·"), ("<<", "·"),
        ("+", "-"), ("~", "!"), ("/", "·"), ("%", "·"), ("^", "·"), ("\r", "\n"),
    )
    more = W["else"] + W["catch"] + W["finally"]
    loop = W["do"] + W["while"]
    ts = False
    hanging = ",-·=&|.æ⇒"

    def __init__(self) -> None:
        super().__init__()
        self.illegal = re.compile(r"[^a0stfgr()\[\]{}·æ…⇒‽±!\-*<>=?:;,.&|@#\n" + KEYS + "]")

    def quoted(self, s: str) -> str:
        if s[0] != "`":
            return "s"
        if "${" not in s:
            return "t"
        out, i = ["t"], 0
        while (k := s.find("${", i)) >= 0:
            depth, j = 1, k + 2
            while depth and j < len(s):
                depth += (s[j] == "{") - (s[j] == "}")
                j += 1
            if depth:
                return "\x01"
            out.append(f"[{super().other(self.lex.sub(lambda m: self.token(m.group()), s[k + 2 : j - 1]))}]")
            i = j
        return "".join(out)

    def other(self, s: str) -> str:
        return "r" if "/" in s else super().other(s)

    def coded(self, text: str, cut: Split | None = None) -> tuple[str, bool]:
        return super().coded(self.headless(text))

    def started(self, text: str, count: int) -> tuple[str, int]:
        return super().started(self.headless(text), count)

    @staticmethod
    def headless(text: str) -> str:
        """Without the line that names an interpreter."""
        return text if not text.startswith("#!") else text[text.find("\n") :] if "\n" in text else ""

    def parses(self, text: str, lender: Grammar | None = None, likely: bool = True) -> bool:
        end = 0 if likely else self.refuted(text := text.replace("\r\n", "\n"))
        if not end and super().parses(text):
            return True
        template = text.find("`") if "${" in text else -1
        if template < 0 or end and template >= end and not text.startswith("#!"):  # the error stands before all templates
            return False
        return super().parses(self.untangled(text))

    _step = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|[`{}]")
    _inside = re.compile(r"\\[\s\S]|`|\$\{")

    def untangled(self, text: str) -> str:
        """Templates within templates brought to a flat form: an empty template with its parts as indices."""
        out, at, depth = [], 0, [0]  # depth of braces for each template part that is open, the file below all
        inside = False
        while True:
            m = (self._inside if inside else self._step).search(text, at)
            if not m:
                out.append("`" if inside else text[at:])
                return "".join(out)
            token = m.group()
            if not inside:
                out.append(text[at : m.start()])
            at = m.end()
            if inside:
                if token == "`":
                    inside = False
                elif token == "${":
                    out.append("[")
                    depth.append(0)
                    inside = False
            elif token == "`":
                out.append("``")
                inside = True
            elif token == "}" and len(depth) > 1 and depth[-1] == 0:
                out.append("]")
                depth.pop()
                inside = True
            else:
                depth[-1] += (token == "{") - (token == "}")
                out.append(token)

    def goes_on(self, token: str) -> bool:
        return token != "" and (token in "·*<>&|?:.‽=æ,⇒t" or token in (W["in"], W["instanceof"]) or kind_of(token) == P or token == "-")

    def items(self, s: str, rule: str) -> bool:
        parts = s.split(",")
        if len(parts) > 1 and not parts[-1]:
            parts.pop()
        return all(self.judged(rule, x, lambda x: self.whole(Cursor, rule, x)) for x in parts)

    def classify(self, kind: int, s: str) -> int:
        roles = 0
        f = s.replace("f", "a").replace("g", "a") if kind != C else s
        if kind != C:
            f = f.replace("\n", "").replace("0", "a").replace("s", "a").replace("r", "a")
        if kind == P:
            if f == "":
                return ARGS | PARAMS
            if ";" in f or W["of"] in f or W["in"] in f:
                roles |= HEADER * self.whole(Cursor, "header", f)
            if ";" in f:
                return roles
            if self.items(f, "assign") and not f.endswith(","):
                roles |= EXPR | ARGS
            elif self.items(f, "spread"):
                roles |= ARGS
            if self.whole(Cursor, "params", f) if self.ts and "<" in f else self.items(f, "param"):
                roles |= PARAMS
            if "," not in f and "=" not in f:
                roles |= CAUGHT * bool(self.judged("caught", f, lambda x: self.whole(Cursor, "caught", x)))
            if self.ts and "=" not in f:
                roles |= TYPE * bool(self.judged("type", f, lambda x: self.whole(Cursor, "type", x)))
            return roles
        if kind == B:
            if f == "":
                return LIST | PATTERN | TUPLE
            parts = f.split(",")
            full = [x for x in parts if x]
            if all(self.judged("spread", x, lambda x: self.whole(Cursor, "spread", x)) for x in full):
                roles |= LIST
            if all(self.judged("param", x, lambda x: self.whole(Cursor, "param", x)) for x in full):
                roles |= PATTERN
            if len(full) == len(parts) and "…" not in f and roles & LIST:
                roles |= INDEX
            if self.ts and (self.whole(Cursor, "tuple_items", f) or W["in"] in f and self.whole(Cursor, "mapped", f)):
                roles |= TUPLE
            return roles
        t = s.replace("\n", "")
        if t == "":
            return BLOCK | OBJECT | CLASS | MEMBERS | NAMES | CASES | ENUM | DESTRUCT
        if ";" not in t:
            roles |= OBJECT * self.items(t, "prop") | NAMES * self.items(t.replace("f", "a").replace("g", "a"), "name_as") | DESTRUCT * self.items(t.replace("f", "a").replace("g", "a"), "destruct")
            if self.ts:
                roles |= ENUM * self.items(t.replace("f", "a").replace("g", "a"), "enum_item")
        if t[0] == W["case"] or t[0] == W["default"]:
            roles |= CASES * self.whole(Cursor, "cases", self.plain(s))
        if self.block(s):
            roles |= BLOCK
        if self.series(s.replace("f", "a"), "member", Cursor, "class_member", ENDS_NL):
            roles |= CLASS
        if self.ts and (";" in t or ":" in t) and self.typed_members(s.replace("f", "a")):
            roles |= MEMBERS
        return roles

    def typed_members(self, s: str) -> bool:
        return self.whole_series(s, "type_member")

    def whole_series(self, s: str, rule: str) -> bool:
        p = Cursor(s, self)
        try:
            while p.at() != "":
                getattr(p, rule)()
            return True
        except Bad:
            return False

    def plain(self, s: str) -> str:
        return s.replace("g", "a") if W["import"] in s or W["export"] in s else s.replace("g", "a").replace("f", "a")

    def block(self, s: str, whole: bool = True) -> bool:
        s = self.plain(s)
        return self.series(s, "statement", Cursor, "statement", ENDS_NL, self.more, self.loop, whole)

    def file(self, s: str, whole: bool = True) -> None:
        if not self.block(s, whole):
            raise Bad


class Typed(Script):
    """TypeScript."""

    ts = True
    keywords = Script.keywords | {k: W[k] for k in TYPED}
    joins = tuple((a, b) for a, b in Script.joins if a not in (">>=", ">>>=", ">="))
