"""Credentials in source code: where they begin, of what type they are, and the source without them.

Literals and comments are read with their context (the name a value is assigned to, the call it is passed to).
How unnatural a value is, is measured in characters per subword of a public vocabulary: words and labels need few
subwords, random strings many.  Formats, names and this measure decide together.  Redaction replaces a value by a
mask of equal length and keeps line ends, so every other offset and line stays.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.bpe import TOKENIZER_DIR, automaton

API, AWS, PASSWORD, JWT, CONNECTION, BEARER, PRIVATE, SECRET = TYPES = ("api_key", "aws_key", "password", "jwt_token", "connection_string", "bearer_token", "private_key", "generic_secret")
#: Random strings have fewer characters per subword than this, words more.
UNNATURAL = 2.6
#: A string without a telling name or format is data rather than a credential from this length on.
UNNAMED_CHARS = 512
#: Characters and lines before a value in which its name is looked for: its statement, as far as the literal before the last one.
CONTEXT, CONTEXT_LINES = 1000, 4

# literals and comments of the languages; a literal may follow another, with or without + between
_STRING = r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|`(?:[^`\\]|\\[\s\S])*`'
_LEX = {
    "py": re.compile(rf"#[^\n]*|{_STRING}"),
    "": re.compile(rf"//[^\n]*|/\*[\s\S]*?\*/|{_STRING}"),
    "settings": re.compile(rf"(?m)^[ \t]*[#;!][^\n]*|(?<=\s)#[^\n]*|{_STRING}"),
}
# Extensions of code; other files are read as settings, where values need no quotes.
_CODE = frozenset("js jsx mjs cjs ts tsx java c h cpp cc cxx hpp hxx cs go rs kt scala swift php".split())
_SETTING = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|-[ \t]+|set[ \t]+)?(?P<name>[A-Za-z_][\w.-]*)[ \t]*[:=][ \t]*(?P<v>[^\s\"'`#][^\n#]*?)[ \t]*(?:[ \t]#[^\n]*)?\r?$")
_JOIN = re.compile(r"[ \t]*(?:\r?\n[ \t]*)?(?:\+[ \t]*(?:\r?\n[ \t]*)?|\\\r?\n[ \t]*)?")

# formats that tell by themselves
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_FORMATS = (
    (JWT, re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}")),
    (CONNECTION, re.compile(r"\b[a-z][a-z0-9+.-]{1,30}://[^\s:/@\"'`<>{}$]*:(?P<v>[^\s/@\"'`<>{}$*]+)@[^\s\"'`/]+(?:/[^\s\"'`]*)?")),
    (AWS, re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    (API, re.compile(r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36}|github_pat_\w{40,}|glpat-[\w-]{20,}|xox[abeoprs]-\d+-[A-Za-z0-9-]{10,}|(?:[a-z]{2,5}_)(?:live|prod|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35}|SG\.[\w-]{16,}\.[\w-]{16,}|sk-[A-Za-z0-9]{24,}|npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])")),
    (BEARER, re.compile(r"\b[Bb]earer[ +]+(?P<v>[A-Za-z0-9._~+/-]{16,}=*)")),
    (API, re.compile(r"[?&](?:api_?key|key|access_?token|token|auth|sig|client_secret|subscription-key)=(?P<v>[A-Za-z0-9._~+/-]{16,}=*)", re.I)),
    (PASSWORD, re.compile(r"(?:^|;)\s*(?:password|pwd)\s*=\s*(?P<v>[^;\s\"'`]{4,})", re.I)),
    (PASSWORD, re.compile(r"\b[A-Z]*(?:PASSWORD|PASSWD|PWD)=(?P<v>[^\s\"'`;]{4,})(?=\s+\w)")),
    (PASSWORD, re.compile(r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[ =]?[\w.-]+:(?P<v>[^\s\"'`]{4,})")),
)
_QUICK = re.compile(r"[0-9]|[A-Z]{12}|[A-Z][a-z]+[^A-Za-z]|://|-----|[a-z] [a-z]+ [a-z]+ [a-z]|[a-z]-[a-z]+-[a-z]+-[a-z]|[a-z]{16}|[=!%*#]")

# What stands in for a credential, and names that look like one.
_PLACEHOLDER = re.compile(
    r"<[^<>]*>|[{\[]|\$[({]|%\(|^%[sd]$|\.\.\.|^(.)\1+$|x{6}|X{6}|0{8}|\*{3}|change.?me|replace|placeholder|redacted|example|sample|dummy|insert|todo|your[-_ ]|[-_ ]here\b|^(?:none|null|true|false|test|secret|password|passwd|token|admin|root)$", re.I
)
_FIELD_NAME = re.compile(r"^(?:[a-z]+_)+(?:id|key|token|secret|password|name|field)$|^X(?:-[A-Z][a-z]+)+$|^[A-Z]+(?:_[A-Z0-9]+)+$|^(?:argon2\w*|bcrypt|scrypt|pbkdf2\w*|sha\d+|md5|[hr]s256)$")
_DIGEST = re.compile(r"^[0-9a-fA-F]{40}$|^[0-9a-fA-F]{64}$|^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^sha\d+[-:]|^data:|^[\d.:TZ+-]+$")
# Endings of names that hold a digest, an id, a picture or a pattern.
_OTHER_NAME = re.compile(r"(?:hash|pattern|regex|digest|checksum|integrity|etag|sha\d*|commit|revision|uuid|guid|trace|icon|image|handler|public_?key|fingerprint|[._-]id|[a-z]Id|^id)$")
# Endings that make the name of a credential one of something about it.
_ABOUT_NAME = re.compile(r"(?:label|hasher|header|field|column|url_?template|hint|prompt|title|message|policy|length|format|path|file|name|type|count|ttl|expiry|version)$")
# Names that hold a credential, by type.
_AWS_NAME = re.compile(r"(?:aws|s3).*(?:secret|key|credentials)|secretaccesskey")
_API_NAME = re.compile(r"clientsecret|api_?key|accesskey|accesstoken|apitoken|(?:mail|maps?|service|geo|push|tiles?|use|auth|app|search|bot|deploy|license|partner|sms)(?:api)?(?:key|token)$|usekey")
_SECRET_NAME = re.compile(r"secret|(?:encryption|hmac|signing|signature|cookie|session|master|cipher|crypt)(?:key|salt)$|salt$|withsecret")
_PASSWORD_NAME = re.compile(r"passw(?:or)?[dt]|passphrase|(?:^|[a-z])pass$|^pass|pwd$|kennwort|clave|contrase|motdepasse|senha|parola|^(?:client)?(?:login|authenticate|connectas|signin|logon)$")
_TOKEN_NAME = re.compile(r"token$|jwt$")

_BEFORE = re.compile(
    r"""(?:(?P<call>[A-Za-z_][\w.]*)\s*\(\s*(?P<first>[A-Za-z_]\w*\s*,\s*)?(?:["'](?P<arg>[^"'\n]+)["']\s*,\s*)?
        |["'](?P<key>[\w .-]+)["']\s*(?P<colon>[:,])\s*|(?P<name>[A-Za-z_][\w-]*)\s*(?::\s*[\w<>\[\]|. ]+?)?\s*=\s*(?:[^;\n"'`]*?(?:\|\||\?\?|\bor\b)\s*)?
        |(?P<prop>[A-Za-z_][\w-]*)\s*:\s*)(?:[A-Za-z_:]+\()?$""",
    re.X,
)
_IN_COMMENT = re.compile(r"(?<![\w/.-])([A-Za-z][\w.-]{2,})[\"']?(?:\s*[:=]\s*|[ \t]+)[\"']?(?=([^\s\"'`,]{6,}))")
_FOUR_WORDS = re.compile(r"^[a-z]{2,}(?:[ -][a-z]{2,}){3}$")
_JOINED_WORDS = re.compile(r"^[a-z]{16,40}$")
# Words of sentences, which passphrases do without.
_SENTENCE = frozenset("a an and are as at be by can cannot do for from has have if in is it its must no not of on or please see the this to use was when with your you that these those into over after before only then than".split())
_NAMED_PASSWORD = re.compile(r"^[A-Z][a-z]+[^A-Za-z0-9\s]?[A-Z][a-z]+\d{2,6}[^A-Za-z0-9\s]?$|^[a-z]{3,6}\d{2,4}[^A-Za-z0-9\s][A-Za-z0-9]{4,8}$")

# Parts of every name that promises a credential, see the names above.
STEMS = ("key", "token", "pass", "secret", "pwd", "login", "salt", "aws", "s3", "jwt", "kennwort", "clave", "contrase", "senha", "parola", "logon", "signin", "authenticate", "connectas")
# Calls whose first argument says who comes in.
_LOGIN = re.compile(r"(?:login|logon|signin|authenticate|connectas)$")
_NEXT_TEXT = re.compile(r"\s*,\s*[\"'`]")
_WEAK_NAME = re.compile(r"(?:password|passwd|pwd|passphrase|passwort|kennwort)$")
_WEAK = re.compile(r"[A-Za-z]{6,}\d*[!?.]?")
# Words that describe a password's field.
_NO_WEAK = frozenset("string text required optional hidden visible invalid missing forgot forgotten current confirm confirmation repeat strong change reset hashed encrypted plaintext varchar unset undefined boolean number object".split())


def stem(text: str) -> bool:
    """Whether a text holds a part of a credential's name."""
    low = text.lower()
    return any(x in low for x in STEMS)


class Finder:
    """Finds credentials with one vocabulary."""

    def __init__(self, vocabulary: str):
        self.model = automaton(vocabulary)

    def chars_per_subword(self, value: str) -> float:
        """Characters per subword."""
        return len(value) / max(1, len(self.model.encode(value)))

    # values
    def plausible(self, v: str) -> bool:
        """Whether a whole literal can be a credential of some type: four words, or one string that is no word."""
        if len(v) < 6:
            return False
        if " " in v:
            return bool(_FOUR_WORDS.match(v))
        return bool(_NAMED_PASSWORD.match(v) or re.search(r"\d", v) and re.search(r"[^\w/.:-]", v)) or self.random(v)

    def random(self, v: str) -> bool:
        return self.chars_per_subword(v) < UNNATURAL

    def holds(self, v: str, kind: str) -> bool:
        """Whether a value can be a credential of the type its name promises."""
        if len(v) < 6 or _PLACEHOLDER.search(v) or _FIELD_NAME.match(v) or "://" in v:
            return False
        if v.isalpha() and (v.isupper() or v.islower()) and stem(v):  # the name of a variable
            return False
        if kind == PASSWORD:
            if _FOUR_WORDS.match(v):
                return not _SENTENCE & set(re.split("[ -]", v))
            if " " in v:
                return False
            if _NAMED_PASSWORD.match(v):
                return True
            return self.random(v) or bool(re.search(r"\d", v) and re.search(r"[^\w/.:-]", v))
        if " " in v or len(v) < 14 or not re.fullmatch(r"[A-Za-z0-9+/=._~-]+", v):
            return False
        if kind == AWS:
            return len(v) >= 30 and self.random(v)
        return bool(re.fullmatch(r"[0-9a-f]{32,}", v)) or self.random(v)

    def shape(self, v: str) -> str | None:
        """The type of a value without a telling name."""
        n = len(v)
        if n < 8 or n > UNNAMED_CHARS or _PLACEHOLDER.search(v) or _FIELD_NAME.match(v) or _DIGEST.match(v):
            return None
        if _NAMED_PASSWORD.match(v):
            return PASSWORD
        if _FOUR_WORDS.match(v):
            return PASSWORD if " " in v and not _SENTENCE & set(v.split()) else None
        if " " in v or not re.search(r"\d", v) or not self.random(v):
            return None
        if re.fullmatch(r"[0-9a-f]{32}", v):
            return API
        if re.fullmatch(r"[0-9a-fA-F]+", v):
            return None
        mixed = re.search("[a-z]", v) and re.search("[A-Z]", v)
        if not mixed:
            return None
        if re.fullmatch(r"[A-Za-z0-9+/]{40}", v):
            return AWS
        if re.fullmatch(r"[a-z]{2,5}[.-][A-Za-z0-9]{20,}", v):
            return API
        if re.fullmatch(r"[A-Za-z0-9]{24,}", v):
            return API
        if re.fullmatch(r"[A-Za-z0-9_-]{20,}|[A-Za-z0-9+/]{20,}={0,2}", v):
            return SECRET
        if n <= 20 and re.fullmatch(r"[A-Za-z0-9!#$%&*+,./:;=?@^_~-]+", v) and "/" not in v:
            return PASSWORD
        return None

    # names
    @staticmethod
    def by_name(name: str | None) -> str | None:
        """The type a name promises, '' for a name that holds something else, None for one that tells nothing."""
        if not name:
            return None
        n = name.lower()
        flat = re.sub(r"[^a-z0-9]", "", n)
        if flat.startswith("get") or flat in ("get", "getenv", "getordefault", "getproperty"):
            return None
        if _AWS_NAME.search(flat):
            return AWS
        if _OTHER_NAME.search(name) or _OTHER_NAME.search(n):
            return None if flat.endswith("keyid") else ""
        if _ABOUT_NAME.search(n):
            return "" if any(x.search(flat) for x in (_API_NAME, _PASSWORD_NAME, _SECRET_NAME, _TOKEN_NAME)) or re.search("token|pass|key|secret", flat) else None
        if _API_NAME.search(flat):
            return API
        if _PASSWORD_NAME.search(flat):
            return PASSWORD
        if _SECRET_NAME.search(flat):
            return SECRET
        if _TOKEN_NAME.search(flat):
            return API
        return None

    @staticmethod
    def weak(v: str, name: str) -> bool:
        """Whether a word is a password because it is assigned to a password's name: no label, no word for the field."""
        flat = v.lower().rstrip("!?.0123456789")
        return bool(_WEAK_NAME.search(re.sub(r"[^a-z]", "", name.lower())) and _WEAK.fullmatch(v)) and not (_PLACEHOLDER.search(v) or _FIELD_NAME.match(v) or stem(v) or flat in _NO_WEAK)

    # texts
    def formats(self, v: str) -> list[tuple[int, int, str]]:
        """(start, end, type) of values that tell by their format."""
        out: list[tuple[int, int, str]] = []
        if "PRIVATE KEY" in v:
            for m in _PEM.finditer(v):
                e = _PEM_END.search(v, m.end())
                end = e.end() if e else len(v)
                if len(re.findall(r"[A-Za-z0-9+/]", v[m.end() : end])) >= 40:
                    out.append((m.start(), end, PRIVATE))
        for kind, pattern in _FORMATS:
            for m in pattern.finditer(v):
                a, b = m.span("v") if "v" in pattern.groupindex else m.span()
                inner = v[a:b]
                if kind == CONNECTION:
                    a, b = m.span()
                if any(a < y and x < b for x, y, _ in out) or _PLACEHOLDER.search(inner if kind != JWT else ""):
                    continue
                if kind == AWS and len(set(inner[4:])) < 6:
                    continue
                if kind in (API, BEARER) and "v" in pattern.groupindex and not self.random(inner):
                    continue
                if kind == PASSWORD and _FIELD_NAME.match(inner):
                    continue
                out.append((a, b, kind))
        return out

    def settings(self, v: str) -> list[tuple[int, int, str]]:
        """Values without quotes behind their names, a line each."""
        out = []
        for m in _SETTING.finditer(v):
            kind, value = self.by_name(m["name"]), m["v"].rstrip(",;")
            if kind and (self.holds(value, kind) or kind == PASSWORD and self.weak(value, m["name"])):
                out.append((m.start("v"), m.start("v") + len(value), kind))
        return out

    def literal(self, v: str, before: str, quick: bool = True, behind: str = "") -> list[tuple[int, int, str]]:
        found = self.formats(v) if quick else []
        if "\n" in v:
            found += [x for x in self.settings(v) if not any(x[0] < y and z < x[1] for z, y, _ in found)]
        if found:
            return found
        t = v.strip()
        if len(t) < 6 or " " in t and not _FOUR_WORDS.match(t) or not (stem(before) or quick and self.plausible(t)):
            return []
        m = _BEFORE.search(before)
        a = v.index(t) if t else 0
        kind = None
        if m:
            call = m["call"].rsplit(".", 1)[-1] if m["call"] else ""
            names = call and not m["arg"] and (_NEXT_TEXT.match(behind) or not m["first"] and _LOGIN.search(re.sub(r"[^a-z]", "", call.lower())))
            kind = self.by_name(call) if call and not names else None  # a user or service comes before its credential
            kind = kind or self.by_name(m["arg"] or m["key"] or m["name"] or m["prop"])
            if kind == "":
                return []
        if kind:
            direct = m["name"] or m["prop"] or (m["colon"] == ":" and m["key"])
            return [(a, a + len(t), kind)] if self.holds(t, kind) or kind == PASSWORD and direct and self.weak(t, direct) else []
        kind = self.shape(t) if quick and self.plausible(t) else None
        return [(a, a + len(t), kind)] if kind else []

    def comment(self, v: str) -> list[tuple[int, int, str]]:
        out = self.formats(v)
        for m in _IN_COMMENT.finditer(v):
            kind = self.by_name(m[1])
            if not kind:
                continue
            value = m[2].rstrip(".;)")
            a = m.start(2)
            b = a + len(value)
            if any(a < y and x < b for x, y, _ in out):
                continue
            plain = kind == PASSWORD and value.isalpha() and not self.random(value)
            if not plain and self.holds(value, kind) and (kind != PASSWORD or re.search(r"[\d!?#$%&*+@^~]", value) or _FOUR_WORDS.match(value)):
                out.append((a, b, kind))
        return out

    def find(self, source: str, lexer: str = "") -> list[tuple[str, list[tuple[int, int]]]]:
        """(type, spans of the value in the source) in order of their beginning; a value in several literals has several spans.

        ``lexer``: py, settings, or '' for languages with // comments.
        """
        out: list[tuple[str, list[tuple[int, int]]]] = []
        quick = _QUICK.search
        group: list[tuple[int, int]] = []
        last_end = -1
        ends = [0, 0]  # of the two literals before

        def close() -> None:
            text = "".join(source[a:b] for a, b in group)
            if len(text) < 6:
                return
            first, hinted = group[0][0], bool(quick(text))
            if not hinted and " " in text:
                return
            lead = source[max(0, first - 1 - CONTEXT, ends[-2]) : first].rstrip("\"'`")
            at = len(lead)
            for _ in range(CONTEXT_LINES):
                if (at := lead.rfind("\n", 0, at)) < 0:
                    break
            lead = lead[max(at, lead.rfind(";")) + 1 :]
            if not hinted and not stem(lead):
                return
            if lead[-1:] in "fFrRbBuUL" and (len(lead) < 2 or not (lead[-2].isalnum() or lead[-2] == "_")):
                lead = lead[:-1]
            starts, at = [], 0
            for a, b in group:
                starts.append(at)
                at += b - a
            for x, y, kind in self.literal(text, lead, hinted, source[last_end : last_end + 40]):
                spans = []
                for k in range(max(0, bisect_right(starts, x) - 1), len(group)):
                    if starts[k] >= y:
                        break
                    a, b = group[k]
                    lo, hi = max(x, starts[k]) - starts[k], min(y - starts[k], b - a)
                    if lo < hi:
                        spans.append((a + lo, a + hi))
                out.append((kind, spans))

        for m in _LEX[lexer].finditer(source):
            a, b = m.span()
            c = source[a]
            if c not in "\"'`":
                text = source[a:b]
                if quick(text):
                    out += [(kind, [(a + x, a + y)]) for x, y, kind in self.comment(text)]
                continue
            triple = b - a >= 6 and source[a : a + 3] in ('"""', "'''")
            if group and not triple and _JOIN.fullmatch(source, last_end, a):
                group.append((a + 1, b - 1))
                last_end = b
                continue
            if group:
                close()
                ends[:] = ends[-1], last_end
            q = 3 if triple else 1
            group = [(a + q, b - q)]
            last_end = b
        if group:
            close()
        if lexer == "settings":
            taken = [s for _, spans in out for s in spans]
            out += [(kind, [(a, b)]) for a, b, kind in self.settings(source) if not any(a < y and x < b for x, y in taken)]
        out.sort(key=lambda x: x[1][0])
        return out


def redact(source: str, found: list[tuple[str, list[tuple[int, int]]]]) -> str:
    """The source with each value masked by text of equal length; line ends stay where they are."""
    out, at = [], 0
    for a, b, kind, head in sorted((a, b, kind, k == 0) for kind, spans in found for k, (a, b) in enumerate(spans)):
        if a < at:
            continue
        tag = f"[REDACTED_{kind.upper()}]" if head else ""
        mask = list(tag if len(tag) <= b - a else "")
        mask += "*" * (b - a - len(mask))
        for k in range(a, b):
            if source[k] in "\r\n":
                mask[k - a] = source[k]
        out += [source[at:a], "".join(mask)]
        at = b
    return "".join([*out, source[at:]])


EVENT = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("original_length", T.IntegerType())])


def scan_sources(df: DataFrame, id_col: str, path_col: str, text_col: str, with_source: bool = True, vocabulary: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id, events ARRAY<STRUCT<line, type, original_length>>[, redacted_source]) of every row, without a shuffle.

    ``line`` counts from 1 in the text; a null text gives no events and a null source, an empty one an empty source;
    without ``with_source`` only rows with events come out.  The path tells Python and settings files, whose values
    need no quotes, from the languages with // comments; a null path counts as one of those.  Repeated rows stay repeated.
    """
    path = f"{directory}/{vocabulary}.json"
    ending = F.lower(F.regexp_extract(F.col(path_col), r"([^./\\]*)$", 1))
    lexer = F.when(F.col(path_col).isNull() | ending.isin(*_CODE), "").when(ending.isin("py", "pyi", "pyw"), "py").otherwise("settings")
    rows = df.select(F.col(id_col).alias("k"), lexer.alias("lexer"), F.col(text_col).alias("t"))
    if not with_source:
        rows = rows.where("length(t) > 6")
    event = pa.struct([("line", pa.int32()), ("type", pa.string()), ("original_length", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(path)
        for batch in batches:
            keep, events, sources = [], [], []
            for i, (lexer, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = finder.find(text, lexer) if text else []
                if not (found or with_source):
                    continue
                keep.append(i)
                events.append([{"line": text.count("\n", 0, s[0][0]) + 1, "type": kind, "original_length": sum(b - a for a, b in s)} for kind, s in found])
                if with_source:
                    sources.append(redact(text, found) if found else text)
            cols = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(events, pa.list_(event))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(sources, pa.string())] * with_source, names=[id_col, "events", *["redacted_source"] * with_source])

    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("events", T.ArrayType(EVENT))]
    return rows.mapInArrow(work, T.StructType(fields + [T.StructField("redacted_source", T.StringType())] * with_source))
