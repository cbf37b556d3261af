"""Assignment-aware secret scan.

Three plain patterns give the base spans. Beside them the source and configuration syntax of each line is lexed into
pairs of a name and a literal or another name; literals are carried along names (``k = "..."`` then ``auth_token = k``)
within the text, and a literal is a secret if the names that reach it are sensitive and it looks random enough.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stratalog.llm._common import column, prepare, python_texts

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run that is too short has no match of this form within it either.
_HEX = re.compile(r"[0-9a-f]{16,}")

#: Words of a name that make it sensitive, and their weight.
NAME_WEIGHTS = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.0, "apikey": 3.0, "api": 0.5, "key": 1.5, "private": 1.0, "access": 1.0, "auth": 1.5, "credential": 2.5, "credentials": 2.5, "bearer": 2.0, "signing": 1.0, "client": 0.5, "encryption": 1.0}
#: Words of a name that speak against a secret, and literals that stand for none.
NAME_AGAINST = {"public": -2.0, "id": -0.5, "name": -1.5, "url": -2.0, "path": -1.5, "file": -1.5, "hash": -1.0, "checksum": -2.0, "count": -2.0, "limit": -2.0, "length": -2.0, "type": -1.5}
PLACEHOLDER = re.compile(r"(?i)(example|changeme|placeholder|your|dummy|sample|x{4,}|\*{3,}|none|null|true|false|todo|test)")
#: From this score on a literal is a secret.
THRESHOLD = 4.5

_N = r"[A-Za-z_$][\w$.\-]*+"
_SUBS = r"""(?:\[[ \t]*+(?:"[^"\n]*+"|'[^'\n]*+'|:?[\w$.\-]++)[ \t]*+\]|(?<=\])\.[\w$.\-]++)*+"""
#: A name of any length, quoted, with subscripts or declared before its type as in Go, and what assigns to it.
_HEAD = re.compile(rf"""(?<![\w$.\-])(?:(?:var|const)[ \t]++(?P<declared>[A-Za-z_]\w*+)[ \t]++[*\[\]]*+[A-Za-z_][\w.]*+(?=[ \t]*+=[^=>])|(?P<quote>["'])(?P<quoted>{_N})(?P=quote)(?:[ \t]*+\])?+|(?P<name>{_N}{_SUBS}))(?P<gap>[ \t]*+)(?P<op>=>|:=|==?(?!=)|\?=|[?!]?:(?!:))[ \t]*+""")
_QUOTED = re.compile(r"""(?:[A-Za-z]{1,2}|@)?(?P<q>"{3}|'{3}|["'`])(?P<literal>(?:(?!(?P=q))[^\n\\]|\\.)*+)(?P=q)""")
_JOINED = re.compile(r"""[ \t]*\+[ \t]*(["'`])((?:(?!\1)[^\n\\]|\\.)*+)\1""")
#: Before a further operand, which is quoted or a name.
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+(?=[A-Za-z_$\"'`])")
#: Unquoted values: to the white space, to a separator of expressions, and as far as the search for further pairs goes on.
_TOKEN, _SHORT, _NEXT = re.compile(r"[^\s\"'`]\S*+"), re.compile(r"[^\s,;()\[\]{}<>&\"'`]++"), re.compile(r"[A-Za-z0-9+/_.=$-]*+")
_REFERENCE = re.compile(rf"\$\{{[A-Za-z_]\w*+\}}|{_N}{_SUBS}")
#: What may end a statement, with a comment that follows at once.
_ENDING = re.compile(r"[,;]++(?:(?://|/\*|\#)\S*+)?$")
_AFTER_NAME = re.compile(r"[,;)\]}]*+(?:(?://|/\*|\#)\S*+)?$")
#: Before a name at the start of a configuration line.
_LEAD = re.compile(r"[ \t]*+(?:(?:export|set|env|ENV|ARG|--env|-e|-)[ \t]++)*+")
_KEY_PARTS = re.compile(r"""[\["'\] \t]+:?""")
_NOTHING = ("", "None", "null", "nil", "undefined")
_OPEN, _CLOSE = {"[": "]", "(": ")", "{": "}", "<": ">"}, set("])}>")
_IN_TYPE = re.compile(r"""=>|->|"(?:[^"\n\\]|\\.)*+"|[\[\](){}<>]""")
_TYPE = re.compile(r"[ \t]*+(?:[&*?][ \t]*+|'\w++[ \t]++|(?:mut|const|readonly|dyn|impl)[ \t]++)*+(?:[\w$.]|::)*+")
_MORE_TYPES, _AFTER_TYPE = re.compile(r"[?!*]*+[ \t]*+[|&]"), re.compile(r"[?!*]*+([ \t]*+)=(?![=>])[ \t]*+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_NAME = re.compile(r"[A-Za-z_$][\w$.]*")


def name_score(name: str) -> float:
    return sum(NAME_WEIGHTS.get(w, 0.0) + NAME_AGAINST.get(w, 0.0) for w in {x.lower() for x in _PARTS.findall(name)})


def literal_score(literal: str) -> float:
    """0 for what is no secret by its form; else bits of entropy a character, more if the literal mixes kinds of characters."""
    n = len(literal)
    if n < 8 or any(c.isspace() for c in literal) or PLACEHOLDER.search(literal) or "://" in literal:
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    if kinds < 2 or not re.search(r"\d", literal):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return entropy * min(1.0, n / 16) + 0.5 * (kinds - 2)


def _closed(text: str, at: int, known: dict[int, int | None]) -> int | None:
    """The end of what the bracket at ``at`` opens. ``known`` keeps answers, so that all of a text's take about one pass."""
    first, stack = at, []
    if at not in known:
        stack.append(at)
        at += 1
    while stack and (m := _IN_TYPE.search(text, at)):
        at, sign = m.end(), m[0]
        if sign in _OPEN:
            if m.start() not in known:
                stack.append(m.start())
            elif known[m.start()] is not None:
                at = known[m.start()]
            elif sign != "<":
                break
        elif sign in _CLOSE:
            while sign != ">" and text[stack[-1]] == "<":
                known[stack.pop()] = None  # less than
                if not stack:
                    return known[first]
            if _OPEN[text[stack[-1]]] == sign:
                known[stack.pop()] = at
            elif sign != ">":
                break
    known |= dict.fromkeys(stack)
    return known[first]


def _annotated(text: str, at: int, known: dict[int, int | None]) -> int | None:
    """Where the value begins if a type and an equals sign follow ``name:``."""
    while True:
        begin, at = at, _TYPE.match(text, at).end()
        if string := _QUOTED.match(text, at):
            at = string.end()
        while at < len(text) and text[at] in _OPEN:
            if (end := _closed(text, at, known)) is None:
                return None
            at = end
        if more := _MORE_TYPES.match(text, at):
            at = more.end()
        else:
            break
    m = _AFTER_TYPE.match(text, at)
    return m.end() if m and at > begin and (m[1] or _QUOTED.match(text, m.end())) else None


def _plain(name: str) -> str:
    """A name with its subscripts as parts after dots."""
    return name if "[" not in name else _KEY_PARTS.sub(".", name).replace("..", ".").strip(".")


def _unquoted(text: str, at: int, config: int) -> tuple[int, int, str, str] | None:
    """Start, end, literal and name of an unquoted value. ``config``: 2 on a line of its own, 1 after white space, else 0."""
    short, ref = _SHORT.match(text, at), _REFERENCE.match(text, at)
    if not config and not short and not ref:
        return None
    end = _TOKEN.match(text, at).end() if config and _TOKEN.match(text, at) else max(m.end() for m in (short, ref) if m) if short or ref else at
    if end == at:
        return None
    if ref:
        follows, word = text[ref.end() : ref.end() + 1], ref[0]
        if follows == "(":
            close = text.find(")", ref.end())
            if not config or text[end - 1] in "(," or (close >= 0 and text.find("\n", ref.end(), close) < 0):
                return at, ref.end(), "", ""  # a call
        elif _AFTER_NAME.match(text, ref.end(), end) if config == 2 else not follows or follows.isspace() or follows in ",;)]}&<>\"'`":
            return at, ref.end(), word if re.search(r"\d", word) and not re.search(r"[\[{]", word) or not _NAME.fullmatch(word) and "[" not in word and "{" not in word else "", _plain(word.strip("${}") if word.startswith("${") else word)
    if not config:
        return (at, short.end(), short[0], "") if short else None
    if m := _ENDING.search(text, at, end):
        end = m.start()
    while config == 1 and end > at and (sign := text[end - 1]) in ")]}" and text.count(sign, at, end) > text.count({")": "(", "]": "[", "}": "{"}[sign], at, end):
        end -= 1
    return at, end, text[at:end], ""


def _operands(text: str, at: int) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, literal and name of each operand that a plus sign adds to the value that ends at ``at``."""
    while plus := _PLUS.match(text, at):
        if lit := _QUOTED.match(text, plus.end()):
            at = lit.end()
            yield lit.start("literal"), lit.end("literal"), lit["literal"], ""
            continue
        ref = _REFERENCE.match(text, plus.end())
        if not ref or text[ref.end() : ref.end() + 1] == "(":
            return
        at = ref.end()
        yield ref.start(), at, "", _plain(ref[0].strip("${}"))


def _pairs(text: str) -> Iterator[tuple[str, int, int, str, str, bool]]:
    """Name, start, end, literal and name of the value of each assignment of a text in order; further operands of a
    sum are pairs of their own, with True."""
    at = line = 0
    known: dict[int, int | None] = {}
    while m := _HEAD.search(text, at):
        name, start = m["declared"] or m["quoted"] or _plain(m["name"]), m.end()
        line = max(line, text.rfind("\n", line, m.start()) + 1)
        if m["op"].endswith(":") and not m["quoted"] and (typed := _annotated(text, start, known)):
            start = typed
        at = start
        if lit := _QUOTED.match(text, start):
            stop, value, at = lit.end("literal"), lit["literal"], lit.end()
            while more := _JOINED.match(text, at):  # "a" + "b" is one literal
                value, stop, at = value + more[2], more.end(2), more.end()
            yield name, lit.start("literal"), stop, value, "", False
            for more in _operands(text, at):
                at = max(at, more[1] + bool(more[2]))  # beyond its quote
                yield name, *more, True
            continue
        config = 0
        if not m["quoted"]:
            lead = _LEAD.match(text, line)
            tight = m["op"] == "=" and not m["gap"] and start == m.end("op")
            config = 2 if lead.end() == m.start() and (tight or text[start : start + 1] not in tuple("([{<")) else 1 if tight and m.start() and text[m.start() - 1].isspace() else 0
        if got := _unquoted(text, start, config):
            at = max(at, _NEXT.match(text, start).end())
            yield name, *got, False
            end, first = got[1], _REFERENCE.match(text, got[0])
            if got[2] and not got[3] and first and text.startswith("+", first.end()):  # a literal, or a sum of names
                end = first.end()
                yield name, first.start(), end, "", _plain(first[0].strip("${}")), True
            for more in _operands(text, end):
                at = max(at, more[1] + bool(more[2]))  # beyond its quote
                yield name, *more, True


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that sensitive names get, straight or through other names.

    A name stands for what was last assigned to it before, or else for what is first assigned to it after; a sum that a
    sensitive name gets is judged by each operand, and stands for its first one where other names get it.
    """
    pairs = list(_pairs(text))
    defined: dict[str, list[int]] = {}
    for k, (name, _, _, value, to, more) in enumerate(pairs):
        if not more and (value or to) not in _NOTHING:
            defined.setdefault(name, []).append(k)

    def meant(k: int) -> int | None:
        """The assignment that the name on the right of assignment ``k`` stands for."""
        to = pairs[k][4]
        own = defined.get(to) or defined.get(to.lstrip("$"))
        if not to or not own:
            return None
        i = bisect_left(own, k)
        return own[i - 1] if i else next((x for x in own[i : i + 2] if x != k), None)

    held: dict[int, tuple[int, int, str]] = {}
    found: dict[tuple[int, int], float] = {}
    for k, (name, *_) in enumerate(pairs):
        way, seen, at = [], set(), k
        while at not in held:
            way.append(at)
            seen.add(at)
            following = meant(at)
            if following is None or following in seen:
                held[at] = pairs[at][1:4]
            else:
                at = following
        for x in way:
            held[x] = held[at]
        of = held[k]
        if of[2] and (by_name := name_score(name)) >= 1.5 and (by_form := literal_score(of[2])):
            found[of[:2]] = max(found.get(of[:2], 0.0), by_name + by_form)
    return [span for span, score in found.items() if score >= THRESHOLD]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, each kind leftmost and without overlaps."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and with the lexer's. A lexed span within a base span tells nothing new and is left out."""
    base = base_spans(text)
    if ":" not in text and "=" not in text:
        return base, base
    more = [(a, 3, b) for a, b in lexed_spans(text) if not any(s <= a and b <= e for s, _, e in base)]
    return base, sorted(base + more)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Null text is empty; texts of any
    length are scanned whole; rows are judged one by one, repeated ones each. An empty table gives an empty result;
    columns beside doc_id and text, whatever their names, are not read."""
    prepare(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(t) for t in python_texts(batch.column(1))]
            counts = [[sum(s[1] == k for s in base) for base, _ in got] for k in range(3)]
            digests = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array([joined(x) for _, x in got], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return rows.mapInArrow(scanned, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
