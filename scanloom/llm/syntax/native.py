"""C and C++.

Names and types can't be told apart without their declarations: a statement is accepted if it reads as a
declaration or as an expression.  Preprocessor lines are taken out; their conditions must be closed.
"""

from __future__ import annotations

import re

from scanloom.llm.syntax.core import Bad, Flat, Grammar, Split, kind_of, word

P, B, C = 0, 1, 2
# roles of ( ), [ ] and { }
EXPR, ARGS, PARAMS, HEADER, TYPE, DECLARATOR, COND = 1, 2, 4, 8, 16, 32, 64
SIZE, EMPTY, CAPTURE, NOTE = 1, 2, 4, 8
BLOCK, VALUES, FIELDS, ENUM, UNIT = 1, 2, 4, 8, 16

# Reserved words of both languages, of C++ alone, and the words that spell arithmetic types.
SHARED = "break case const continue default do else enum extern for goto if inline register return sizeof static struct switch typedef union volatile while restrict _Noreturn _Thread_local _Alignas _Alignof _Static_assert _Atomic _Generic __attribute__ __restrict __inline __extension__ asm __asm__".split()
PLUS = "alignas alignof catch class concept consteval constexpr constinit const_cast decltype delete dynamic_cast explicit export friend mutable namespace new noexcept operator private protected public reinterpret_cast requires static_assert static_cast template thread_local throw try typename using virtual co_await co_return co_yield typeid and or not".split()
ARITHMETIC = "void char short int long float double signed unsigned _Bool _Complex".split()
W = {k: word(k) for k in SHARED + PLUS}
W["final"], W["override"] = word("final"), word("override")
STORAGE = "".join(W[k] for k in "extern inline register static typedef const volatile restrict _Noreturn _Thread_local _Atomic __restrict __inline __extension__ constexpr consteval constinit explicit friend mutable virtual thread_local".split())
CASTS = "".join(W[k] for k in "const_cast dynamic_cast reinterpret_cast static_cast".split())
QUALS = "".join(W[k] for k in "const volatile restrict __restrict _Atomic".split())
ACCESS = "".join(W[k] for k in "private protected public".split())


class Cursor(Flat):
    __slots__ = ()

    @property
    def plus(self) -> bool:
        return self.g.plus

    # names
    def name(self) -> None:
        """A name, in C++ with scopes and template arguments."""
        if not self.plus:
            self.need("a")
            return
        self.take("∷")
        while True:
            self.take(W["template"])
            self.take("!")
            if self.take(W["operator"]):
                self.operator_name()
            else:
                self.need("a")
                if self.next_is("<"):
                    self.attempt(self.template_args)
            if self.next_is("∷") and self.after() != "*":
                self.i += 1
                continue
            return

    def operator_name(self) -> None:
        if self.group(B, EMPTY) or self.take(W["new"] + W["delete"]):
            self.group(B, EMPTY)
        elif self.at() == self.g.empty_paren:
            self.i += 1
        elif self.take("·*-<>&|=æ!±→,"):
            while self.take("·-<>=&|"):
                pass
        else:
            self.type()

    def template_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            if not self.attempt(self.template_type):
                self.shift()
            self.take("…")
            if not self.take(","):
                break
        self.need(">")

    def template_type(self) -> None:
        self.type()
        self.take("…")
        self.group(P, PARAMS)
        if not self.next_is(",>"):
            raise Bad

    def template_head(self) -> None:
        self.need(W["template"])
        self.need("<")
        while not self.take(">"):
            if self.next_is(W["template"]):
                self.template_head()
            if self.take(W["typename"] + W["class"]):
                self.take("…")
                self.take("a")
                if self.take("="):
                    self.type()
            else:
                self.specifiers()
                self.take("…")
                if not self.next_is(",>="):
                    self.declarator()
                if self.take("="):
                    self.shift()
            if not self.take(","):
                self.need(">")
                break
        if self.take(W["requires"]):
            self.shift()

    # types
    def notes(self) -> None:
        while True:
            if self.take(W["__attribute__"] + W["alignas"] + W["_Alignas"]):
                self.need_group(P, ARGS | TYPE | PARAMS)
            elif self.plus and self.group(B, NOTE):
                pass
            else:
                return

    def specifiers(self) -> None:
        """Storage words and exactly one type."""
        typed = False
        while True:
            self.notes()
            c = self.at()
            if c == "":
                break
            if c in STORAGE:
                self.i += 1
                if c == W["extern"] and self.next_is("s"):
                    self.i += 1
                elif c == W["explicit"] and self.is_group(P, EXPR) and self.after() == "a":
                    self.i += 1
            elif c == "p":
                if typed == 2:
                    raise Bad
                typed = 1
                self.i += 1
            elif typed:
                break
            elif c == "u":  # auto
                typed = 2
                self.i += 1
            elif c in (W["struct"], W["union"], W["enum"]) or c == W["class"]:
                self.i += 1
                typed = 2
                self.compound(c)
            elif c == W["typename"]:
                self.i += 1
                self.name()
                typed = 2
            elif c == W["decltype"]:
                self.i += 1
                self.need_group(P, EXPR)
                typed = 2
            elif c == "a" or self.plus and c == "∷":
                self.name()
                typed = 2
                if self.s[self.i - 1] == "∷":
                    raise Bad
            else:
                break
        if not typed:
            raise Bad

    def compound(self, c: str) -> None:
        self.notes()
        if c == W["enum"]:
            if self.plus:
                self.take(W["class"] + W["struct"])
            named = self.take("a")
            if self.plus and self.take(":"):
                self.type()
            if not self.group(C, ENUM) and not named:
                raise Bad
            return
        named = self.is_name()
        if named:
            self.name()
        self.take(W["final"])
        if self.plus and self.next_is(":") and self.after() and (self.after() in ACCESS + W["virtual"] or self.after() in "a∷"):
            self.i += 1
            while True:
                self.take(W["virtual"])
                self.take(ACCESS)
                self.take(W["virtual"])
                self.name()
                self.take("…")
                if not self.take(","):
                    break
            self.need_group(C, FIELDS)
        elif not self.group(C, FIELDS) and not named:
            raise Bad

    def is_name(self) -> bool:
        return self.next_is("a∷" if self.plus else "a")

    def pointers(self) -> None:
        while True:
            if self.take("*" + QUALS) or self.plus and (self.take("&") or self.take("⩓")):
                continue
            return

    def type(self) -> None:
        self.specifiers()
        self.pointers()
        if self.is_group(P, DECLARATOR) and kind_of(self.after()) == P:
            self.i += 1
            self.need_group(P, PARAMS)
        while self.group(B, EMPTY | SIZE):
            pass

    def declarator(self, named: bool = True) -> None:
        self.pointers()
        if self.is_name() or self.plus and (self.next_is(W["operator"]) or self.next_is("!")):
            self.name()
            if self.plus and self.next_is("∷") and self.after() == "*":
                self.i += 2
                self.take("a")
        elif self.plus and self.group(B, CAPTURE):
            return
        elif not self.group(P, DECLARATOR):
            if named:
                raise Bad
        while True:
            if self.group(B, EMPTY | SIZE):
                continue
            if self.is_group(P, PARAMS):
                self.i += 1
                if self.plus:
                    self.function_tail()
                continue
            break
        if self.take(W["asm"] + W["__asm__"]):
            self.need_group(P, ARGS)
        self.notes()

    def function_tail(self) -> None:
        while True:
            if self.take(W["const"] + W["volatile"] + W["override"] + W["final"] + "⩓&"):
                continue
            if self.take(W["noexcept"]):
                self.group(P, EXPR)
            elif self.take(W["throw"]):
                self.need_group(P, ARGS | PARAMS)
            elif self.take("→"):
                self.type()
            elif self.take(W["requires"]):
                self.shift()
            else:
                return

    # expressions
    def exprs(self) -> None:
        self.expr()
        while self.take(","):
            self.expr()

    def expr(self) -> None:
        if self.plus and self.take(W["throw"] + W["co_yield"]):
            if not self.next_is(";,)") and self.at() != "":
                self.expr()
            return
        self.binary(True)
        if self.take("?"):
            self.exprs()
            self.need(":")
            self.expr()
        elif self.take("=æ"):
            self.value()

    def value(self) -> None:
        if not self.group(C, VALUES):
            self.expr()

    def shift(self) -> None:
        self.binary(False)

    def binary(self, greater: bool) -> None:
        self.unary()
        while True:
            c = self.at()
            if c == "":
                return
            if c == ">":
                if not greater:
                    return
                while self.take(">"):
                    pass
                self.take("=")
            elif c in "·*-<&|⩓" or self.plus and c in (W["and"], W["or"]):
                self.i += 1
                if c == "→":
                    raise Bad
            else:
                return
            self.unary()

    def cast(self) -> None:
        self.need_group(P, TYPE)
        if self.group(C, VALUES):
            return
        nxt = self.at()
        if nxt == "" or not (nxt in "a0s!-±*&∷⩓" + W["sizeof"] + W["new"] + CASTS or kind_of(nxt) == P):
            raise Bad
        self.unary()

    def unary(self) -> None:
        while self.take("!-±*&⩓") or self.plus and self.take(W["not"] + W["co_await"]):
            pass
        c = self.at()
        if c == "":
            raise Bad
        if self.is_group(P, TYPE) and self.attempt(self.cast):
            return
        if c in (W["sizeof"], W["_Alignof"], W["alignof"], W["typeid"], W["noexcept"]):
            self.i += 1
            if self.take("…"):
                self.need_group(P, EXPR)
            elif not self.group(P, TYPE):
                self.unary()
            return
        if self.plus and c == "∷" and self.after() and self.after() in W["new"] + W["delete"]:
            self.i += 1
            c = self.at()
        if self.plus and c == W["new"]:
            self.i += 1
            self.group(P, ARGS)
            if not self.group(P, TYPE):
                self.specifiers()
                self.pointers()
                while self.group(B, SIZE):
                    pass
            self.group(P, ARGS) or self.group(C, VALUES)
            return
        if self.plus and c == W["delete"]:
            self.i += 1
            self.group(B, EMPTY)
            self.unary()
            return
        self.chain()
        self.take("±")

    def chain(self) -> None:
        self.primary()
        while True:
            c = self.at()
            if c == "." or c == "→":
                self.i += 1
                self.take("*")
                self.name()
            elif not (self.group(P, ARGS) or self.group(B, SIZE)):
                if self.plus and self.is_group(C, VALUES) and self.s[self.i - 1] in "a>":
                    self.i += 1
                    continue
                return

    def primary(self) -> None:
        c = self.at()
        if c == "":
            raise Bad
        if c in "0s":
            self.i += 1
            while self.next_is("sa") and self.s[self.i - 1] == "s" and (self.s[self.i] == "s" or self.after() == "s"):
                self.i += 1  # macros between strings
        elif c in CASTS:
            self.i += 1
            self.need("<")
            self.type()
            self.need(">")
            self.need_group(P, EXPR)
        elif c == W["_Generic"]:
            self.i += 1
            self.need_group(P, ARGS | PARAMS | EXPR)
        elif self.plus and self.is_group(B, CAPTURE | EMPTY):
            self.i += 1
            if self.group(P, PARAMS):
                self.take(W["mutable"])
                self.function_tail()
            self.need_group(C, BLOCK)
        elif self.plus and c == "p" or c == W["typename"]:
            self.specifiers()
            if not (self.group(P, ARGS) or self.group(C, VALUES)):
                raise Bad
        elif self.is_name() or self.plus and c == W["operator"]:
            self.name()
        elif not (self.group(P, EXPR) or self.group(P, COND)):
            raise Bad

    # declarations
    def initial(self) -> None:
        if self.take("="):
            self.value()
        elif self.plus:
            self.group(C, VALUES) or self.group(P, ARGS)

    def declaration(self) -> None:
        self.specifiers()
        if self.take(";"):
            return
        while True:
            self.declarator()
            if self.take(":"):
                self.shift()
            self.initial()
            if not self.take(","):
                break
        self.need(";")

    def function(self) -> None:
        """A definition; in C++ also of constructors, destructors and conversions, which have no type."""
        if not self.attempt(self.typed_head):
            if not self.plus:
                raise Bad
            while self.take(STORAGE):
                pass
            self.name()
            self.need_group(P, PARAMS)
            self.function_tail()
        while not self.plus and self.attempt(self.declaration):
            pass  # parameters of the old style
        if self.plus:
            if self.take("="):
                self.need(W["default"] + W["delete"] + "0")
                self.need(";")
                return
            tried = self.take(W["try"])
            if self.take(":"):
                while True:
                    self.name()
                    if not (self.group(P, ARGS) or self.group(C, VALUES)):
                        raise Bad
                    self.take("…")
                    if not self.take(","):
                        break
            if self.take(";"):
                return
            self.need_group(C, BLOCK)
            while tried and self.take(W["catch"]):
                self.need_group(P, PARAMS)
                self.need_group(C, BLOCK)
            return
        self.need_group(C, BLOCK)

    def typed_head(self) -> None:
        self.specifiers()
        self.declarator()
        if not (kind_of(self.s[self.i - 1]) == P or self.plus):
            raise Bad
        if not (self.is_group(C, BLOCK) or self.plus and self.next_is("=:" + W["try"]) or not self.plus and self.at()):
            raise Bad
        if self.plus and self.next_is("=") and self.after() not in (W["default"], W["delete"], "0"):
            raise Bad

    def outer(self) -> None:
        c = self.at()
        if c == ";":
            self.i += 1
            return
        if self.plus:
            if c == W["namespace"] or c == W["inline"] and self.after() == W["namespace"]:
                self.take(W["inline"])
                self.i += 1
                self.notes()
                if self.is_name():
                    self.name()
                    if self.take("="):
                        self.name()
                        self.need(";")
                        return
                self.need_group(C, UNIT)
                return
            if c == W["using"]:
                self.using()
                return
            if c == W["template"]:
                if self.attempt(self.template_head):
                    if self.take(W["concept"]):
                        self.need("a")
                        self.need("=")
                        self.exprs()
                        self.need(";")
                    else:
                        self.outer()
                    return
                self.i += 1  # explicit instantiation
                self.declaration()
                return
            if c in (W["static_assert"],):
                self.i += 1
                self.need_group(P, ARGS)
                self.need(";")
                return
        if c == W["_Static_assert"]:
            self.i += 1
            self.need_group(P, ARGS)
            self.need(";")
            return
        if c == W["extern"] and self.after() == "s":
            i = self.i
            self.i += 2
            if self.group(C, UNIT):
                return
            self.i = i
        if not self.attempt(self.declaration) and not self.attempt(self.function):
            self.need("a")  # a macro that stands alone
            self.need_group(P, ARGS)
            self.need(";")

    def using(self) -> None:
        self.need(W["using"])
        if self.take(W["namespace"]):
            self.name()
        elif self.next_is("a") and self.after() == "=":
            self.i += 2
            self.type()
        else:
            self.take(W["typename"])
            self.name()
        self.need(";")

    def field(self) -> None:
        if self.plus:
            while self.next_is(ACCESS):
                self.i += 1
                self.need(":")
            if self.at() != "":
                self.outer()
            return
        if not self.take(";"):
            self.specifiers()
            if self.take(";"):
                return
            while True:
                if not self.next_is(":"):
                    self.declarator()
                if self.take(":"):
                    self.shift()
                if not self.take(","):
                    break
            self.need(";")

    # statements
    def statement(self) -> None:
        self.notes()
        c = self.at()
        if c == "":
            raise Bad
        if c == ";" or self.is_group(C, BLOCK):
            self.i += 1
        elif c == W["if"]:
            self.i += 1
            self.take(W["constexpr"])
            self.need_group(P, EXPR | COND)
            self.statement()
            if self.take(W["else"]):
                self.statement()
        elif c == W["for"]:
            self.i += 1
            self.need_group(P, HEADER)
            self.statement()
        elif c == W["while"] or c == W["switch"]:
            self.i += 1
            self.need_group(P, EXPR | COND)
            self.statement()
        elif c == W["do"]:
            self.i += 1
            self.statement()
            self.need(W["while"])
            self.need_group(P, EXPR)
            self.need(";")
        elif c == W["return"] or c == W["co_return"]:
            self.i += 1
            if not self.next_is(";") and not self.group(C, VALUES):
                self.exprs()
            self.need(";")
        elif c == W["break"] or c == W["continue"]:
            self.i += 1
            self.need(";")
        elif c == W["goto"]:
            self.i += 1
            self.take("*")
            self.need("a")
            self.need(";")
        elif c == W["case"]:
            self.i += 1
            self.binary(True)
            if self.take("…"):
                self.binary(True)
            self.need(":")
            if self.at() != "":
                self.statement()
        elif c == W["default"]:
            self.i += 1
            self.need(":")
            if self.at() != "":
                self.statement()
        elif self.plus and c == W["try"]:
            self.i += 1
            self.need_group(C, BLOCK)
            self.need(W["catch"])
            self.need_group(P, PARAMS)
            self.need_group(C, BLOCK)
            while self.take(W["catch"]):
                self.need_group(P, PARAMS)
                self.need_group(C, BLOCK)
        elif self.plus and c in (W["using"], W["namespace"], W["static_assert"], W["template"]):
            self.outer()
        elif c == W["_Static_assert"]:
            self.outer()
        elif c in W["asm"] + W["__asm__"]:
            self.i += 1
            while self.take(QUALS + W["goto"]):
                pass
            self.need_group(P, ARGS | EXPR | PARAMS)
            self.need(";")
        elif c == "a" and self.after() == ":":
            self.i += 2
            if self.at() != "":
                self.statement()
        elif not self.attempt(self.declaration):
            self.exprs()
            self.need(";")

    # parts of groups
    def param(self) -> None:
        if self.take("…"):
            return
        if self.plus:
            self.notes()
        self.specifiers()
        self.take("…")
        self.declarator(named=False)
        if self.plus and self.take("="):
            self.value()

    def params(self) -> None:
        while True:
            self.param()
            if not self.take(","):
                return

    def header(self) -> None:
        if self.plus and self.attempt(self.each):
            return
        if not self.attempt(self.declaration):
            if not self.next_is(";"):
                self.exprs()
            self.need(";")
        if not self.next_is(";"):
            self.exprs()
        self.need(";")
        if self.at() != "":
            self.exprs()

    def each(self) -> None:
        self.specifiers()
        self.declarator()
        self.need(":")
        self.value()

    def condition(self) -> None:
        self.specifiers()
        self.declarator()
        if not self.next_is("=") and not self.is_group(C, VALUES):
            raise Bad
        self.initial()

    def initial_condition(self) -> None:
        if not self.attempt(self.declaration):
            self.exprs()
            self.need(";")
        if not self.attempt(self.condition):
            self.exprs()

    def arg(self) -> None:
        if not self.group(C, VALUES) or self.at() != "":
            self.expr()
        self.take("…")

    def designated(self) -> None:
        some = False
        while True:
            if self.take("."):
                self.need("a")
            elif not (self.next_is(chr(0xE000)) or self.group(B, SIZE)):
                break
            some = True
        if some:
            if not self.is_group(C, VALUES):
                self.need("=")
        self.value()
        self.take("…")

    def enum_item(self) -> None:
        self.need("a")
        self.notes()
        if self.take("="):
            self.shift_all()

    def shift_all(self) -> None:
        self.expr()

    def inner_declarator(self) -> None:
        if self.plus and self.is_name() and self.after() == "∷":
            self.name()
            self.need("∷")
        elif self.plus and self.next_is("a") and not self.next_is("*&"):
            self.i += 1
            while self.take("∷"):
                if self.next_is("*"):
                    break
                self.need("a")
        else:
            self.take("^")
        self.declarator(named=False)


class Native(Grammar):
    """C; with ``plus`` C++."""

    number = re.compile(r"(?:0[xX][\da-fA-F']*\.?[\da-fA-F]*(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d+)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]{0,3}|_\w+|i|ms|us|ns|s|h|min)")
    lex = re.compile(
        r"^[ \t]*#(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*"
        r"|[^\W\d][\w$]*+(?![\"'])|(?:[^\w\"'/.#\n]|\.(?!\d))++|\n++"
        r"|//[^\n]*|/\*[\s\S]*?\*/|\b(?:u8|[uUL])?R\"(?P<d>[^()\\\s]{0,16})\([\s\S]*?\)(?P=d)\"|(?:\b(?:u8|[uUL]))?\"(?:[^\"\\\n]|\\[\s\S])*\"|(?:\b(?:u8|[uUL]))?'(?:[^'\\\n]|\\.)[^'\n]{0,9}'"
        r"|[^\W\d][\w$]*|\.?\d(?:[\w.]|'(?=\w)|(?<=[eEpP])[+-])*",
        re.M,
    )
    joins = (
        ("...", "…"), ("<=>", "·"), ("->", "→"), ("::", "∷"), ("<<=", "æ"), (">>=", "æ"), ("==", "·"), ("!=", "·"), ("<=", "·"), (">=", "·"), ("||", "·"), ("++", "±"), ("--", "±"),
        ("+=", "æ"), ("-=", "æ"), ("*=", "æ"), ("/=", "æ"), ("%=", "æ"), ("&=", "æ"), ("|=", "æ"), ("^=", "æ"), ("<<", "·"), ("&&", "⩓"), ("+", "-"), ("~", "!"), ("/", "·"), ("%", "·"), ("^", "·"),
    )
    # Directives of the preprocessor.
    directives = frozenset("include include_next import define undef if ifdef ifndef elif elifdef elifndef else endif line error warning pragma ident embed".split())
    more = W["else"] + W["catch"]
    loop = W["do"] + W["while"]

    def __init__(self, plus: bool) -> None:
        super().__init__()
        self.plus = plus
        words = SHARED + (PLUS if plus else [])
        self.keywords = {k: W[k] for k in words} | {k: "p" for k in ARITHMETIC} | {"auto": "u"}
        if plus:
            self.keywords |= {k: "p" for k in ("bool", "wchar_t", "char8_t", "char16_t", "char32_t")} | {"final": W["final"], "override": W["override"]}
        self.illegal = re.compile(r"[^a0spu()\[\]{}·æ…→⩓±!\-*<>=?:;,.&|" + "∷" * plus + "".join(self.keywords[k] for k in words) + (W["final"] + W["override"]) * plus + "]")
        self.empty_paren = chr(0xE000 + ARGS + PARAMS)

    _char = re.compile(r"'(?:[^'\\\n]|\\.)[^'\n]{0,9}'")
    _apart = re.compile(r"\b(?:u8|[uULR])[\"']|\d'\w")

    def lent(self, cut: Split, text: str) -> bool | None:
        if self._apart.search(text):
            return False
        if cut.template or cut.dollar or not all(map(self._char.fullmatch, cut.single)):
            return None
        if cut.apart:
            return False
        if cut.hashed:  # a directive needs this language's cut, unless none of C begins so
            for k, t in enumerate(cut.tokens):
                if "#" in t and t[0] not in "\"'/":
                    tail, nxt = t[t.rindex("#") + 1 :], cut.tokens[k + 1] if k + 1 < len(cut.tokens) else ""
                    if "\n" not in tail and nxt and not cut.between[k + 1] and (tail.strip(" \t") or nxt not in self.directives and not nxt[0].isdigit()):
                        return None
            return False
        return True

    def other(self, s: str) -> str:
        directive = s.lstrip(" \t")
        if directive[:1] != "#":
            return super().other(s)
        s = directive
        m = re.match(r"#\s*(\w*)", s)
        if m[1] and m[1] not in self.directives and not m[1].isdigit():
            return "\x01"
        if m[1] in ("if", "ifdef", "ifndef"):
            self.depth += 1
        elif m[1] == "endif":
            self.depth -= 1
            if self.depth < 0:
                return "\x01"
        return " "

    def flat(self, text: str, lender: Grammar | None = None) -> str:
        self.depth = 0
        s = super().flat(text, lender)
        if self.depth:
            raise Bad
        return s

    def started(self, text: str, count: int) -> tuple[str, int]:
        self.depth = 0
        return super().started(text, count)

    def settled(self, s: str, joined: bool) -> str:
        s = super().settled(s, joined)
        while "ss" in s:
            s = s.replace("ss", "s")
        return s

    def keeps(self, s: str) -> bool:
        return s.lstrip(" \t")[:1] != "#"  # directives count open conditions

    def token(self, s: str) -> str:
        if s[-1] in "\"'" and s[0] in "\"'uULR":
            return "s"
        return super().token(s)

    def classify(self, kind: int, s: str) -> int:
        whole = lambda rule, x: bool(self.judged(rule, x, lambda y: self.whole(Cursor, rule, y)))
        if kind == P:
            if s == "":
                return ARGS | PARAMS
            if ";" in s:
                return HEADER * whole("header", s) | COND * whole("initial_condition", s)
            roles = 0
            f = s.replace("0", "a").replace("s", "a")
            if self.plus and "<" in s:
                if whole("exprs", f):
                    roles |= EXPR | ARGS
            elif all(whole("arg", x) for x in f.split(",")):
                roles |= ARGS
                if whole("exprs", f):
                    roles |= EXPR
            if not roles & ARGS and "," in s and all(whole("arg", x) or whole("type", x) for x in s.split(",")):
                roles |= ARGS  # macros and templates take types
            if s[0] not in "0s!-" and whole("params", s):
                roles |= PARAMS
            if "," not in s or self.plus:
                if whole("type", s):
                    roles |= TYPE | (0 if roles & ARGS else ARGS)
                if s[0] in "*&⩓a^" or self.plus and "∷" in s or kind_of(s[0]) == P:
                    roles |= DECLARATOR * whole("inner_declarator", s)
                if self.plus and ":" in s:
                    roles |= HEADER * whole("each", s)
                if self.plus and "=" in s:
                    roles |= COND * whole("condition", s)
            if not roles and len(s) == 1 and kind_of(s) == C and (ord(s) - 0xE000) & BLOCK:
                roles = COND  # a block as an expression
            return roles
        if kind == B:
            if s == "":
                return EMPTY
            roles = SIZE * whole("expr", s)
            if s[0] == W["static"]:
                roles |= SIZE * whole("expr", s[1:])
            if self.plus:
                roles |= CAPTURE * all(re.fullmatch(r"[=&]|&?a(?:=.*)?|\*?a|&?a…|…?a", x) is not None for x in s.split(","))
                o = ord(s[0]) - 0xE000
                roles |= NOTE * (len(s) == 1 and 0 <= o < 0x600 and o >> 9 == B)
            return roles
        if s == "":
            return BLOCK | VALUES | FIELDS | UNIT
        roles = 0
        if ";" not in s:
            parts = s.split(",") if not (self.plus and "<" in s) else [s]
            if not parts[-1] and len(parts) > 1:
                parts.pop()
            roles |= VALUES * all(whole("designated", x) for x in parts)
            roles |= ENUM * all(whole("enum_item", x) for x in parts)
        if s[-1] in ";:" or kind_of(s[-1]) == C:
            roles |= BLOCK * self.series(s, "statement", Cursor, "statement", more=self.more, loop=self.loop)
            if self.plus:
                roles |= FIELDS * self.series(s, "field", Cursor, "field", more=W["catch"])
                roles |= UNIT * self.series(s, "outer", Cursor, "outer", more=W["catch"])
            else:
                roles |= FIELDS * self.series(s, "field", Cursor, "field")
                if s.find(";") < 0 or roles & FIELDS:
                    roles |= 0
        return roles

    def file(self, s: str, whole: bool = True) -> None:
        if not self.series(s, "outer", Cursor, "outer", more=W["catch"] * self.plus, whole=whole):
            raise Bad
