"""Bracket-wise parsing with shared results.

A text is brought to one character per token, comments and layout gone.  Then bracket groups are judged from the
inside, in one pass with a stack, and each is replaced by one character that says what it may be (an argument list, a
block, a type ...); what remains is judged as the whole file.  A group or a statement has a short flat form, and
equal forms occur in many files, so that each form goes through the recursive-descent grammar once per worker.

As any parser stops at the first error, a grammar that hardly reads a text first judges the text's first tokens in the
same way, and ends there if no text of its language begins so.
"""

from __future__ import annotations

import re
from itertools import islice

BRACKET = re.compile(r"([()\[\]{}])")
BASE = 0xE000
KINDS = {"(": 0, "[": 1, "{": 2}
CLOSE = {"(": ")", "[": "]", "{": "}"}
CURLY = f"\\u{BASE + 0x400:04x}-\\u{BASE + 0x5FF:04x}"
ENDS = re.compile(f"[;{CURLY}]")
ENDS_NL = re.compile(f"[;\n{CURLY}]")
#: Forms kept per worker and grammar; beyond it the table is emptied.
FORMS = 400_000
#: Longer groups aren't kept, for they hardly come again.
LONGEST_FORM = 400
#: Tokens after which a text is looked at for an error that stands already, before all of it is read.
STARTS = (16, 48)

_LINES = re.compile("\n+")
_names: dict[str, str] = {}


def word(name: str) -> str:
    """The character that stands for a keyword."""
    return _names.setdefault(name, chr(0x100 + len(_names)))


def kind_of(token: str) -> int:
    """0, 1 or 2 for what was ( ), [ ] or { }, else -1."""
    o = ord(token) - BASE if token else -1
    return o >> 9 if 0 <= o < 0x600 else -1


class Bad(Exception):
    """The text does not parse."""


class Undecided(Exception):
    """A rule went deeper than the interpreter allows; the text may be valid or not."""


class Flat:
    """A cursor over a flat token string; grammars derive from it."""

    __slots__ = ("s", "i", "n", "g", "open_end", "far")

    def __init__(self, s: str, g: Grammar):
        self.s, self.i, self.n, self.g, self.open_end, self.far = s, 0, len(s), g, False, 0

    def skip(self) -> None:
        s, n = self.s, self.n
        while self.i < n and s[self.i] == "\n":
            self.i += 1

    def at(self) -> str:
        """The next token, line ends skipped; '' at the end."""
        s, n, i = self.s, self.n, self.i
        while i < n and s[i] == "\n":
            i += 1
        self.i = i
        if i > self.far:
            self.far = i
        return s[i] if i < n else ""

    def next_is(self, chars: str) -> bool:
        c = self.at()
        return c != "" and c in chars

    def after(self) -> str:
        """The token behind the next one."""
        j = self.i + 1
        while j < self.n and self.s[j] == "\n":
            j += 1
        if j > self.far:
            self.far = j
        return self.s[j] if j < self.n else ""

    def take(self, chars: str) -> bool:
        c = self.at()
        if c != "" and c in chars:
            self.i += 1
            return True
        return False

    def need(self, chars: str) -> None:
        if not self.take(chars):
            raise Bad

    def is_group(self, kind: int, roles: int) -> bool:
        c = self.at()
        if c == "":
            return False
        o = ord(c) - BASE
        return 0 <= o < 0x600 and o >> 9 == kind and bool(o & roles)

    def group(self, kind: int, roles: int) -> bool:
        if self.is_group(kind, roles):
            self.i += 1
            return True
        return False

    def need_group(self, kind: int, roles: int) -> None:
        if not self.group(kind, roles):
            raise Bad

    def attempt(self, rule, *args) -> bool:
        """Try a rule; the cursor stays where it was if the rule fails."""
        i = self.i
        try:
            rule(*args)
            return True
        except Bad:
            self.i = i
            return False


class Tokens(dict):
    """The character of each token text, filled as tokens are met; beyond FORMS entries it is emptied."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar

    def __missing__(self, s: str) -> str:
        got = self.grammar.token(s)
        if len(s) <= LONGEST_FORM and self.grammar.keeps(s):
            if len(self) >= FORMS:
                self.clear()
            self[s] = got
        return got


class Split:
    """A text cut at the tokens of a lexical pattern.  Languages that share a pattern share the last text's cut."""

    def __init__(self, lex: re.Pattern):
        self.pattern = re.compile(f"({lex.pattern})", lex.flags)
        self.step = self.pattern.groups + 1
        self.plain = None if lex.groups else lex.findall  # enough where nothing stands between tokens
        self.text: str | None = None

    def __call__(self, text: str) -> Split:
        """Itself with the text's ``tokens`` and what stands ``between`` them."""
        if text != self.text:
            self.tokens = self.plain(text) if self.plain else []
            if sum(map(len, self.tokens)) == len(text):
                self.between = [""] * (len(self.tokens) + 1)
            else:
                parts = self.pattern.split(text)
                self.between, self.tokens = parts[:: self.step], parts[1 :: self.step]
            self.text, self.loose = text, "".join(self.between)
        return self

    def compared(self) -> None:
        """What tells whether another language cuts the text alike."""
        rest = [t for t in set(self.tokens) if not t[0].isalpha()]
        telling = [t for t in rest if t[0] not in "_$\"'/"]
        first = {t[0] for t in rest}
        self.single = [t for t in rest if t[0] == "'"]
        self.template, self.dollar, self.hashed = "`" in first, "$" in first, any("#" in t for t in telling)
        self.broken = any("\n" in t for t in rest if t[0] == '"')
        # what other languages may cut in another way: regular expressions and hexadecimal fractions
        self.apart = any("/" in t and t[:2] not in ("//", "/*") for t in rest if t[0] in " \t/") or any(t[0] == "0" and t[-1] in "pP" for t in telling)


_splits: dict[re.Pattern, Split] = {}


class Grammar:
    """One language: its tokens, what bracket groups may be, and what a file is.

    Subclasses give ``lex`` (pattern of names, numbers, texts, comments, and of runs of all else, the frequent ones first), ``keywords``, ``joins`` (replacements of longer operators), ``allowed``
    (pattern of a character that no valid flat text has) and the rules ``classify`` and ``file``.
    """

    keywords: dict[str, str] = {}
    joins: tuple[tuple[str, str], ...] = ()
    number = re.compile(r"0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
    lines_matter = False

    #: Tokens with which no statement ends, so that a line that does goes on.
    hanging = ""

    def __init__(self) -> None:
        self.forms: dict[str, str] = {}
        self.known: dict[tuple, object] = {}
        self.tokens = Tokens(self)
        self.cut = _splits.setdefault(self.lex, Split(self.lex))

    # tokens
    def token(self, s: str) -> str:
        k = self.keywords.get(s)
        if k is not None:
            return k
        c = s[0]
        if c.isalpha() or c in "_$":
            return self.named(s)
        if c.isdigit() or c == "." and s[1:2].isdigit():
            return "0" if self.number.fullmatch(s) else "\x01"
        if c == "/" and s[1:2] in ("/", "*"):
            return "\n" if self.lines_matter and "\n" in s else " "
        return self.quoted(s) if c in "\"'`" else self.other(s)

    def keeps(self, s: str) -> bool:
        """Whether a token means the same wherever it stands."""
        return True

    def named(self, s: str) -> str:
        return "a"

    def quoted(self, s: str) -> str:
        return "s"

    def other(self, s: str) -> str:
        """Operators, brackets and layout between two tokens, joined and without blanks."""
        for a, b in self.joins:
            s = s.replace(a, b)
        if not self.lines_matter:
            return "".join(s.split())
        lines = ["".join(x.split()) for x in f"{s}.".splitlines()]
        lines[-1] = lines[-1][:-1]
        return _LINES.sub("\n", "\n".join(lines))

    def lent(self, cut: Split, text: str) -> bool | None:
        """Whether another language's cut of the text is this one's too; None where this language refuses the text anyway."""
        return False

    def coded(self, text: str, cut: Split | None = None) -> tuple[str, bool]:
        """The text with a character for each token, and whether all its operators stand in tokens."""
        cut = cut or self.cut(text)
        codes = map(self.tokens.__getitem__, cut.tokens)
        if not cut.loose:
            return "".join(codes), True
        out = [""] * (2 * len(cut.between) - 1)
        out[::2] = cut.between
        out[1::2] = codes
        return "".join(out), False

    def flat(self, text: str, lender: Grammar | None = None) -> str:
        text = text.replace("\r\n", "\n")
        cut = None
        if lender is not None and lender is not self and lender.cut.text == text and not text.startswith("#!"):
            cut = lender.cut
            cut.compared()
            fits = self.lent(cut, text)
            if fits is None:
                raise Bad
            cut = cut if fits else None
        return self.settled(*self.coded(text, cut))

    def settled(self, s: str, joined: bool) -> str:
        """Operators joined, blanks gone; refused if a character remains that no valid text has."""
        if not joined:
            for a, b in self.joins:
                s = s.replace(a, b)
        if not self.lines_matter:
            s = "".join(s.split()) if not joined else s.replace(" ", "")
        elif joined:
            s = _LINES.sub("\n", s.replace(" ", "")).strip("\n")
        else:
            s = "\n".join("".join(x.split()) for x in s.splitlines() if x and not x.isspace())
        if self.illegal.search(s):
            raise Bad
        return s

    def started(self, text: str, count: int) -> tuple[str, int]:
        """The flat form of a text's first tokens and where it ends in the text; nothing if these are all."""
        found = list(islice(self.lex.finditer(text), count))
        if len(found) < count:
            return "", 0
        tokens = [m[0] for m in found]
        end = found[-1].end()
        if sum(map(len, tokens)) == end:
            return self.settled("".join(map(self.tokens.__getitem__, tokens)), True), end
        while tokens and not tokens[-1][0].isalpha():  # what follows may be joined with operators, but not with a name
            tokens.pop()
        out, at = [], 0
        for m, t in zip(found, tokens):
            out += text[at : m.start()], self.tokens[t]
            at = m.end()
        return self.settled("".join(out), False), at

    def refuted(self, text: str) -> int:
        """Where a text's beginning ends with which no text of this language can begin, 0 if none is found.

        Tokens, groups and statements are judged as in the whole text; what the cut leaves open is held to be right.
        """
        for count in STARTS:
            try:
                self.reach = len(text)
                s, self.reach = self.started(text, count)
                if not self.reach:
                    return 0
                self.file(self.reduced(s, whole=False), whole=False)
            except Bad:
                return self.reach
            except RecursionError:
                return 0
        return 0

    # groups
    def reduced(self, s: str, whole: bool = True) -> str:
        """The text with a character for each outermost bracket group, however deep it is nested; if it isn't ``whole``, up to the first group that is open."""
        pieces = BRACKET.split(s)
        out = pieces[:1]  # what no group has taken yet: texts, open brackets and the characters of groups
        opened: list[int] = []
        known = self.forms.get
        for c, after in zip(pieces[1::2], pieces[2::2]):
            if c in KINDS:
                opened.append(len(out))
                out += c, after
            else:
                if not opened:
                    raise Bad
                k = opened.pop()
                form = "".join(out[k:]) + c
                out[k:] = known(form) or self._reduce(form), after
        if opened:
            if whole:
                raise Bad
            del out[opened[0] :]
        return "".join(out)

    def _reduce(self, s: str) -> str:
        if CLOSE[s[0]] != s[-1]:
            raise Bad
        kind = KINDS[s[0]]
        roles = self.classify(kind, s[1:-1])
        if not roles:
            raise Bad
        got = chr(BASE + (kind << 9) + roles)
        if len(s) <= LONGEST_FORM:
            if len(self.forms) >= FORMS:
                self.forms.clear()
            self.forms[s] = got
        return got

    def parses(self, text: str, lender: Grammar | None = None, likely: bool = True) -> bool:
        """Whether the text is a file of this language; comments alone and the empty text are.

        ``lender``: a grammar that may have cut the text, for those that cut most texts alike.
        ``likely``: False if an error is to be expected soon; the answer is the same.
        """
        try:
            if not likely and self.refuted(text.replace("\r\n", "\n")):
                return False
            self.file(self.reduced(self.flat(text, lender)))
            return True
        except Bad:
            return False
        except RecursionError as e:
            raise Undecided from e

    # shared judgements
    def judged(self, name: str, s: str, rule) -> object:
        key = (name, s)
        got = self.known.get(key)
        if got is None:
            got = rule(s)
            if len(s) <= LONGEST_FORM:
                if len(self.known) >= FORMS:
                    self.known.clear()
                self.known[key] = got
        return got

    def whole(self, cls, rule: str, s: str) -> bool:
        """Whether one rule of a cursor class reads all of ``s``."""
        p = cls(s, self)
        try:
            getattr(p, rule)()
            p.skip()
            return p.i == p.n
        except Bad:
            return False

    def series(self, s: str, name: str, cls, rule: str, ends: re.Pattern = ENDS, more: str = "", loop: str = "", whole: bool = True) -> bool:
        """Whether ``s`` is a series of items, each ending with ; or a block (or, where lines matter, a line).

        ``more``: words that go on with the item before them; ``loop``: (do, while), where only a do takes the while.
        If ``s`` isn't ``whole``, whether it can be the beginning of one.
        """
        i, n = 0, len(s)

        def judge(cand: str) -> int:  # 1 yes, 2 yes, if the text may end there, 0 not yet, -1 whatever follows
            p = cls(cand, self)
            try:
                getattr(p, rule)()
                p.skip()
                if p.i == p.n:
                    return 1 + p.open_end
            except Bad:
                pass
            return -1 if p.far < p.n else 0  # the end was not looked at

        while True:
            while i < n and s[i] == "\n":
                i += 1
            if i >= n:
                return True
            j = i
            while True:
                m = ends.search(s, j)
                j = m.end() if m else n
                k = j
                while k < n and s[k] == "\n":
                    k += 1
                nxt = s[k] if k < n else ""
                if not whole and not nxt:
                    return self.judged(name, s[i:], judge) >= 0
                if nxt and (nxt in more or loop and nxt == loop[1] and loop[0] in s[i:j]) and j < n:
                    if nxt in more or not self.judged(name, s[i:j], judge):
                        j = k + 1
                        continue
                if m and m.group() == "\n" and j < n and nxt and (self.goes_on(nxt) or s[j - 2] in self.hanging):
                    continue
                if m and m.group() == "\n":
                    cand = s[i : j - 1]
                else:
                    cand = s[i:j]
                got = self.judged(name, cand, judge)
                if got == 1 or got == 2 and (nxt == "" or j < n and (s[j - 1] == "\n" or s[j] == "\n") and not self.goes_on(nxt)):
                    i = j
                    break
                if j >= n or got < 0:
                    return False

    def goes_on(self, token: str) -> bool:
        """Whether a line that begins with this token goes on with the statement before it."""
        return False
