"""Reads one COBOL source into flat facts; runs in Python workers, one call per file.

The text becomes logical lines, the lines become words, and one pass over the words with
the place (division, section, paragraph) as state yields the facts. A sentence is cut
into statements at verbs; a data clause reaches to its period. There is no tree: data
items get their parents by a stack of level numbers as they come.

A fact is (fact, ord, line, name, owner, attrs, items); see FACTS for what they hold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: What name, owner, attrs and items hold by kind of fact.
FACTS = {
    "unit": "program name or file stem; attrs: format, copybook",
    "division": "name", "section": "name; owner: division", "paragraph": "name; owner: section",
    "data": "name; owner: qualified name of the parent; attrs: level, qualified, child, picture, usage, value, redefines, occurs, group, area; items: siblings",
    "file": "name; attrs: record",
    "copy": "copybook; items: words after REPLACING",
    "call": "target; owner: paragraph; attrs: kind, section; items: USING arguments",
    "perform": "target; owner: paragraph; attrs: section, thru",
    "sql": "operation; owner: paragraph; attrs: text; items: tables",
    "cics": "command; owner: paragraph; attrs: program, transaction, map, file",
    "access": "file; owner: paragraph; attrs: operation, mode, record",
    "assign": "target; attrs: verb, literal",
    "use": "variable; owner: paragraph; attrs: section, verb, access, qualified",
    "flow": "from; owner: paragraph; attrs: section, to, via",
    "trouble": "message",
}

#: Words of the language (fixed values).
VERBS = frozenset(
    "ACCEPT ADD ALTER CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE EVALUATE EXEC EXIT GO GOBACK IF INITIALIZE INSPECT MERGE MOVE MULTIPLY OPEN PERFORM READ RELEASE RETURN "
    "REWRITE SEARCH SET SORT START STOP STRING SUBTRACT UNSTRING WHEN ELSE WRITE".split()
)
DIVISIONS = frozenset("IDENTIFICATION ID ENVIRONMENT DATA PROCEDURE".split())
NOT_VARIABLES = VERBS | frozenset(
    "TO FROM INTO BY GIVING USING RETURNING OF IN THAN THEN AND OR NOT EQUAL EQUALS GREATER LESS IS ARE WITH ON SIZE ERROR OVERFLOW AT END INVALID KEY ROUNDED REMAINDER UNTIL VARYING TIMES THRU "
    "THROUGH AFTER BEFORE TEST ALL FOR DELIMITED DELIMITER COUNT POINTER TALLYING REPLACING INITIAL LEADING TRAILING FIRST CHARACTERS CONVERTING REFERENCE CONTENT VALUE ADDRESS LENGTH FUNCTION "
    "UP DOWN TRUE FALSE NEXT SENTENCE PROGRAM RUN NUMERIC ALPHABETIC POSITIVE NEGATIVE INPUT OUTPUT I-O EXTEND RECORD UPON ADVANCING LINE LINES PAGE CORRESPONDING CORR ASCENDING DESCENDING "
    "ZERO ZEROS ZEROES SPACE SPACES HIGH-VALUE HIGH-VALUES LOW-VALUE LOW-VALUES QUOTE QUOTES NULL NULLS DATE DAY TIME EXCEPTION NO".split()
)
#: Access of the operands of a verb: at first, and after each marking word (fixed values).
ACCESS = {
    "MOVE": ("read", {"TO": "write"}), "ADD": ("read", {"TO": "both", "GIVING": "write"}), "SUBTRACT": ("read", {"FROM": "both", "GIVING": "write"}), "MULTIPLY": ("read", {"BY": "both", "GIVING": "write"}),
    "DIVIDE": ("read", {"INTO": "both", "GIVING": "write", "REMAINDER": "write"}), "COMPUTE": ("write", {"=": "read"}), "SET": ("write", {"TO": "read", "UP": "read", "DOWN": "read"}),
    "INITIALIZE": ("write", {}), "STRING": ("read", {"INTO": "write", "DELIMITED": "read", "POINTER": "both", "OVERFLOW": "read"}),
    "UNSTRING": ("read", {"INTO": "write", "TALLYING": "write", "DELIMITED": "read", "DELIMITER": "write", "COUNT": "write", "POINTER": "both", "OVERFLOW": "read"}),
    "INSPECT": ("both", {"TALLYING": "write", "REPLACING": "write", "BEFORE": "read", "AFTER": "read"}), "ACCEPT": ("write", {}), "READ": ("read", {"INTO": "write"}), "WRITE": ("read", {}), "REWRITE": ("read", {}),
    "CALL": ("read", {"USING": "both", "GIVING": "write", "RETURNING": "write"}), "SORT": ("read", {"GIVING": "write"}), "MERGE": ("read", {"GIVING": "write"}), "RELEASE": ("read", {}), "RETURN": ("read", {"INTO": "write"}),
    **{v: ("read", {}) for v in ("DISPLAY", "DELETE", "START", "SEARCH", "EVALUATE", "IF", "PERFORM", "OPEN", "CLOSE")},
}
FLOWING = frozenset("MOVE COMPUTE ADD SUBTRACT MULTIPLY DIVIDE SET STRING UNSTRING INSPECT READ WRITE REWRITE SORT MERGE RELEASE RETURN".split())
OPEN_MODES = frozenset("INPUT OUTPUT I-O EXTEND".split())
OPEN_WORDS = frozenset("WITH NO REWIND LOCK SHARING REVERSED".split())
USING_ENDS = frozenset("GIVING RETURNING END-CALL ON EXCEPTION OVERFLOW".split())

_WORDS = re.compile(
    r"""(?P<pic>\bPIC(?:TURE)?\b(?:[ \t]+IS\b)?[ \t]+(?P<shape>[^\s.]+(?:\.(?=[^\s.])[^\s.]+)*))|(?P<str>'[^']*'?|"[^"]*"?)|(?P<end>\.(?=\s|$))|(?P<num>[+-]?\d[\d.]*(?<!\.)(?![\w-])|\d+(?![\w-]))"""
    r"""|(?P<word>[A-Za-z0-9][\w-]*)|(?P<sign>[().=<>+\-*/,;:])""",
    re.I | re.A,
)
_LEVELS = frozenset(map(str, [*range(1, 50), 66, 77, 88])) | frozenset(f"0{i}" for i in range(1, 10))


def logical_lines(text: str) -> tuple[bool, list[tuple[int, str]]]:
    """Whether the source is in fixed columns, and its numbered code lines without comments, continuations joined."""
    raw = text.replace("\r\n", "\n").split("\n")
    filled = [s for s in raw if s.strip()]
    columns = re.compile(r"[A-Za-z0-9 ]{6}[ */\-dD]")
    fixed = bool(filled) and sum(bool(columns.match(s)) for s in filled) >= 0.6 * len(filled)
    out: list[tuple[int, str]] = []
    for number, s in enumerate(raw, 1):
        mark = s[6:7]
        if mark == "*" or (fixed and (len(s) < 7 or mark in "/dD")):
            continue
        if fixed and mark == "-":
            if out:
                out[-1] = (out[-1][0], out[-1][1] + s[11:].lstrip())
            continue
        body = s[7:72] if fixed else s
        body = body.split("*>", 1)[0]
        if body.strip():
            out.append((number, body))
    return fixed, out


@dataclass
class Word:
    kind: str
    text: str
    line: int

    @property
    def up(self) -> str:
        return self.text.upper()


def words_of(lines: list[tuple[int, str]]) -> list[Word]:
    out: list[Word] = []
    for number, s in lines:
        for m in _WORDS.finditer(s):
            kind = m.lastgroup if m.lastgroup != "shape" else "pic"
            if kind == "pic":
                out += [Word("word", "PIC", number), Word("shape", m.group("shape"), number)]
            else:
                out.append(Word(kind, m.group() if kind == "str" else m.group().upper(), number))
    return out


def sql_tables(text: str) -> list[str]:
    """Tables after FROM, JOIN, UPDATE, INSERT INTO, MERGE INTO; sorted."""
    t = re.sub(r"([A-Z0-9_-])\s*\.\s*([A-Z0-9_-])", r"\1.\2", text.upper())
    return sorted(set(re.findall(r"\b(?:FROM|JOIN|UPDATE|(?:INSERT|MERGE)\s+INTO)\s+([A-Z0-9][A-Z0-9_.-]*)", t)))


def host_variables(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r":\s*([A-Z][A-Z0-9-]*)", text.upper())))


def _parts(text: str) -> list[str]:
    """Pieces between commas outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()] if text[start:].strip() else out


def column_bindings(operation: str, text: str) -> list[tuple[str, str]]:
    """(column, host variable) of INSERT with lists, SELECT INTO and UPDATE SET; anything unclear gives none."""
    t = text.upper()
    host = re.compile(r":\s*([A-Z][A-Z0-9-]*)\s*")
    plain = re.compile(r"[A-Z][A-Z0-9_]*")
    if operation == "UPDATE":
        m = re.search(r"\bSET\s+(.+?)(?:\s+WHERE\b|\s+END-EXEC\b|\s*$)", t, re.S)
        made = [re.fullmatch(r"([A-Z][A-Z0-9_]*)\s*=\s*:\s*([A-Z][A-Z0-9-]*)\s*", p) for p in _parts(m.group(1))] if m else []
        return [(x.group(1), x.group(2)) for x in made if x]
    shape = {"INSERT": r"INSERT\s+INTO\s+[A-Z0-9_.\s-]+?\(([^)]+)\)\s*VALUES\s*\(([^)]+)\)", "SELECT": r"SELECT\s+(.+?)\s+INTO\s+(.+?)\s+FROM\b"}.get(operation)
    m = re.search(shape, t, re.S) if shape else None
    if not m or len(a := _parts(m.group(1))) != len(b := _parts(m.group(2))):
        return []
    return [(c, h.group(1)) for c, v in zip(a, b) if plain.fullmatch(c) and (h := host.fullmatch(v))]


def variable(word: Word) -> bool:
    return word.kind == "word" and word.up not in NOT_VARIABLES and not word.up.startswith("END-") and not word.up[0].isdigit() and any(c.isalpha() for c in word.up)


@dataclass
class Reader:
    """Collects the facts of one source."""

    file: str
    facts: list[tuple] = field(default_factory=list)
    files: dict[str, str | None] = field(default_factory=dict)

    def put(self, fact: str, line: int, name: str, owner: str | None = None, items: list[str] | None = None, **attrs: object) -> None:
        self.facts.append((fact, len(self.facts), line, name, owner, {k: str(v) for k, v in attrs.items() if v is not None}, items or []))

    def read(self, text: str) -> list[tuple]:
        fixed, lines = logical_lines(text)
        w = words_of(lines)
        stem = re.sub(r"\.(cpy|cbl|cob)$", "", self.file.rsplit("/", 1)[-1], flags=re.I)
        copybook = self.file.lower().endswith(".cpy")
        name = next((w[j].text.strip("'\"") for i, x in enumerate(w) if x.up == "PROGRAM-ID" for j in range(i + 1, min(i + 4, len(w))) if w[j].kind in ("word", "str") and w[j].up != "IS"), "")
        self.put("unit", 1, name or stem, format="fixed" if fixed else "free", copybook=str(copybook).lower())
        self._walk(w, copybook)
        return self.facts

    # ---- places ------------------------------------------------------------------

    def _walk(self, w: list[Word], copybook: bool) -> None:
        division, section, paragraph, area = ("DATA" if copybook else ""), "", "", "working"
        items: list[dict] = []
        i, fresh = 0, True  # fresh: at the start of a sentence
        last_file: str | None = None
        while i < len(w):
            x, nxt = w[i], w[i + 1] if i + 1 < len(w) else Word("end", ".", w[i].line)
            if x.kind == "end":
                i, fresh = i + 1, True
                continue
            if x.kind == "word" and x.up in DIVISIONS and nxt.up == "DIVISION":
                division, section, paragraph = ("IDENTIFICATION" if x.up == "ID" else x.up), "", ""
                self.put("division", x.line, division)
                i = self._to_end(w, i)
                continue
            if x.kind == "word" and nxt.up == "SECTION" and fresh:
                section, paragraph = x.up, ""
                self.put("section", x.line, section, division)
                area = {"LINKAGE": "linkage", "FILE": "file"}.get(section, "working")
                i = self._to_end(w, i)
                continue
            if x.up == "COPY" and x.kind == "word":
                stop = self._to_end(w, i)
                self._copy(w[i:stop], paragraph)
                i, fresh = stop, True
                continue
            if division == "DATA" or (division == "" and x.text in _LEVELS):
                stop = self._to_end(w, i)
                clause = [y for y in w[i:stop] if y.kind != "end"]
                if x.up in ("FD", "SD") and len(clause) > 1:
                    last_file = clause[1].up
                    self.files[last_file] = None
                    self.put("file", x.line, last_file)
                elif x.text in _LEVELS and fresh:
                    item = self._data(clause, area)
                    items.append(item)
                    if area == "file" and last_file and self.files.get(last_file) is None and item["level"] == 1:
                        self.files[last_file] = item["name"]
                i, fresh = stop, True
                continue
            if division == "PROCEDURE":
                if fresh and x.kind in ("word", "num") and nxt.kind == "end" and x.up not in VERBS:
                    paragraph = x.up
                    self.put("paragraph", x.line, paragraph, section or "(default)")
                    i, fresh = i + 2, True
                    continue
                if x.kind == "word" and x.up in VERBS:
                    stop = self._statement_end(w, i)
                    self._statement([y for y in w[i:stop] if y.kind != "end"], section or "(default)", paragraph or "(default)")
                    fresh = w[stop - 1].kind == "end"
                    i = stop
                    continue
                i, fresh = i + 1, False
                continue
            i, fresh = i + 1, False
        self._hierarchy(items)

    @staticmethod
    def _to_end(w: list[Word], i: int) -> int:
        while i < len(w) and w[i].kind != "end":
            i += 1
        return i + 1

    @staticmethod
    def _statement_end(w: list[Word], i: int) -> int:
        start = w[i]
        block = start.up == "EXEC"
        i += 1
        while i < len(w):
            x = w[i]
            if x.kind == "end":
                return i + 1
            if x.kind == "word" and x.up.startswith("END-") and (not block or x.up == "END-EXEC"):
                return i + 1
            if not block and x.kind == "word" and x.up in VERBS and x.line != start.line:
                return i
            i += 1
        return i

    # ---- data --------------------------------------------------------------------

    def _data(self, c: list[Word], area: str) -> dict:
        level = int(c[0].text)
        named = len(c) > 1 and c[1].kind == "word" and c[1].up not in ("PIC", "USAGE", "VALUE", "VALUES", "OCCURS", "REDEFINES", "COMP", "COMP-3")
        item: dict = {"level": level, "name": c[1].up if named else "FILLER", "line": c[0].line, "area": area}
        usages = {"COMP", "COMP-1", "COMP-2", "COMP-3", "COMP-4", "COMP-5", "COMPUTATIONAL", "BINARY", "PACKED-DECIMAL", "DISPLAY", "INDEX", "POINTER"}
        for k, x in enumerate(c[1 + named :], 1 + named):
            after = next((y for y in c[k + 1 :] if y.up not in ("IS", "ARE")), None)
            if x.kind == "shape":
                item["picture"] = x.text.upper()
            elif x.kind != "word" or after is None and x.up not in usages:
                continue
            elif x.up == "REDEFINES":
                item["redefines"] = after.up
            elif x.up == "OCCURS" and after.text.isdigit():
                item["occurs"] = int(after.text)
            elif x.up in ("VALUE", "VALUES"):
                item["value"] = after.text
            elif x.up == "USAGE":
                item["usage"] = after.up
            elif x.up in usages and "usage" not in item and c[k - 1].up not in ("USAGE", "IS"):
                item["usage"] = x.up
        return item

    def _hierarchy(self, items: list[dict]) -> None:
        """Parents by level: the nearest lower level before; 66 and 77 stand alone, 88 belongs to the item before."""
        for area in ("working", "linkage", "file"):
            roots: list[dict] = []
            stack: list[dict] = []
            mine = [x for x in items if x["area"] == area]
            for x in mine:
                x["children"], x["path"] = [], [x["name"]]
                special = x["level"] in (66, 77, 88)
                if not special:
                    while stack and stack[-1]["level"] >= x["level"]:
                        stack.pop()
                parent = None if x["level"] in (66, 77) or not stack else stack[-1]
                family = roots if parent is None else parent["children"]
                if parent is not None:
                    x["path"], x["parent"] = [*parent["path"], x["name"]], ".".join(parent["path"])
                    x["parent_ord"] = parent
                x["child"], x["family"] = len(family), family
                family.append(x)
                if not special:
                    stack.append(x)
            number = {id(x): n for n, x in enumerate(mine)}
            for x in mine:
                group = "picture" not in x and bool(x["children"])
                self.put(
                    "data", x["line"], x["name"], x.get("parent"), [y["name"] for y in x["family"] if y["name"] != x["name"]], level=x["level"], qualified=".".join(x["path"]), child=x["child"],
                    picture=x.get("picture"), usage=x.get("usage"), value=x.get("value"), redefines=x.get("redefines"), occurs=x.get("occurs"), group=str(group).lower(), children=len(x["children"]),
                    area=area, item=f"{area}:{number[id(x)]}", parent_item=f"{area}:{number[id(x['parent_ord'])]}" if "parent_ord" in x else None,
                )
        for f in [t for t in self.facts if t[0] == "file"]:
            if self.files.get(f[3]):
                f[5]["record"] = self.files[f[3]]

    # ---- statements ----------------------------------------------------------------

    def _copy(self, c: list[Word], paragraph: str) -> None:
        c = [x for x in c if x.kind != "end"]
        if len(c) < 2:
            return
        at = next((k for k, x in enumerate(c) if x.up == "REPLACING"), None)
        self.put("copy", c[0].line, c[1].text.strip("'\"").upper(), paragraph or None, [x.up for x in c[at + 1 :]] if at is not None else [])

    def _statement(self, s: list[Word], section: str, paragraph: str) -> None:
        verb, line = s[0].up, s[0].line
        if verb == "EXEC":
            self._exec(s, section, paragraph)
            return
        if verb == "CALL" and len(s) > 1:
            target = s[1]
            using = next((k for k, x in enumerate(s) if x.up == "USING"), len(s))
            args = []
            for x in s[using + 1 :]:
                if x.up in USING_ENDS:
                    break
                if variable(x):
                    args.append(x.up)
            kind = "literal" if target.kind == "str" else "identifier"
            name = target.text.strip("'\"")
            self.put("call", line, name if kind == "literal" else name.upper(), paragraph, args, kind=kind, section=section)
            for a in args:
                self.put("flow", line, a, paragraph, section=section, to=name.upper(), via="CALL")
        elif verb == "PERFORM":
            if len(s) > 1 and s[1].kind == "word" and s[1].up not in NOT_VARIABLES:
                thru = next((s[k + 1].up for k, x in enumerate(s[:-1]) if x.up in ("THRU", "THROUGH")), None)
                self.put("perform", line, s[1].up, paragraph, section=section, thru=thru)
        elif verb in ("OPEN", "CLOSE", "READ", "WRITE", "REWRITE", "DELETE"):
            self._access(s, paragraph)
        self._assigns(s)
        self._uses(s, section, paragraph)

    def _exec(self, s: list[Word], section: str, paragraph: str) -> None:
        text = " ".join(x.text for x in s)
        kind, line = (s[1].up if len(s) > 1 else ""), s[0].line
        command = s[2].up if len(s) > 2 else None
        if kind == "CICS":
            arg = lambda k: (m.group(1).upper() if (m := re.search(rf"\b{k}\s*\(\s*['\"]?([A-Z0-9_.-]+)['\"]?\s*\)", text, re.I)) else None)
            self.put("cics", line, command or "UNKNOWN", paragraph, program=arg("PROGRAM"), transaction=arg("TRANSID") or arg("TRANSACTION"), map=arg("MAP"), file=arg("FILE"))
        elif kind == "SQL" and command:
            tables = sql_tables(text)
            self.put("sql", line, command, paragraph, tables, text=text, section=section)
            self._sql_flows(command, text.upper(), tables, line, section, paragraph)

    def _sql_flows(self, op: str, text: str, tables: list[str], line: int, section: str, paragraph: str) -> None:
        via = f"EXEC SQL {op}"
        into = text.find(" INTO ")
        put = lambda a, b: self.put("flow", line, a, paragraph, section=section, to=b, via=via)
        if op == "SELECT" and into >= 0:
            stop = text.find(" FROM ", into)
            got, rest = (text[into:stop], text[stop:]) if stop >= 0 else (text[into:], "")
            for t in tables:
                for v in host_variables(got):
                    put(f"SQL:{t}", v)
                for v in host_variables(rest):
                    put(v, f"SQL:{t}")
        elif op == "FETCH" and into >= 0:
            cursor = (text[text.find("FETCH ") + 6 : into].split() or ["CURSOR"])[0]
            for v in host_variables(text[into:]):
                put(f"SQL:{cursor}", v)
        elif op in ("INSERT", "UPDATE", "DELETE"):
            for v in host_variables(text):
                for t in tables:
                    put(v, f"SQL:{t}")

    def _access(self, s: list[Word], paragraph: str) -> None:
        verb, line = s[0].up, s[0].line
        named = [x.up.strip("'\"") for x in s[1:] if x.kind in ("word", "str")]
        put = lambda f, **a: self.put("access", line, f, paragraph, operation=verb, **a)
        if verb == "OPEN":
            mode, done = None, False
            for n in named:
                if n in OPEN_MODES:
                    mode, done = n, False
                elif n in self.files or (not self.files and mode and not done and n not in OPEN_WORDS):
                    put(n, mode=mode)
                    done = True
        elif verb == "CLOSE":
            for n in named:
                if not self.files or n in self.files:
                    put(n)
        elif verb == "READ":
            if named:
                put(next((n for n in named if n in self.files), named[0]))
        elif named:
            by_record = {r: f for f, r in self.files.items() if r}
            target = by_record.get(named[0]) or next((n for n in named if n in self.files), None)
            if target:
                put(target, record=named[0])

    def _assigns(self, s: list[Word]) -> None:
        """Writes that matter to the value of a program name in a variable; qualified targets are passed over."""
        verb, line = s[0].up, s[0].line
        marks = [x.up for x in s]
        qualified = lambda part: any(x.up in ("OF", "IN") for x in part)
        if verb == "MOVE" and "TO" in marks:
            at = marks.index("TO")
            source, targets = s[1:at], s[at + 1 :]
            if len(source) == 1 and source[0].kind in ("word", "str", "num") and not qualified(targets):
                literal = source[0].text.strip("'\"") if source[0].kind == "str" else None
                for t in targets:
                    if t.kind == "word" and not variable(t):
                        break
                    if t.kind == "word":
                        self.put("assign", line, t.up, verb=verb, literal=literal)
        elif verb == "INITIALIZE" or (verb == "UNSTRING" and "INTO" in marks):
            rest = s[1:] if verb == "INITIALIZE" else s[marks.index("INTO") + 1 :]
            run = []
            for x in rest:
                if not variable(x):
                    if x.up in ("OF", "IN"):
                        run = []
                    break
                run.append(x)
            for t in run:
                self.put("assign", line, t.up, verb=verb)
        elif verb == "ACCEPT" or (verb in ("STRING", "READ") and "INTO" in marks):
            rest = s[1:] if verb == "ACCEPT" else s[marks.index("INTO") + 1 :]
            if rest and variable(rest[0]) and not (len(rest) > 1 and rest[1].up in ("OF", "IN")):
                self.put("assign", line, rest[0].up, verb=verb)

    def _uses(self, s: list[Word], section: str, paragraph: str) -> None:
        verb, line = s[0].up, s[0].line
        access, markers = ACCESS.get(verb, ("both", {}))
        found: list[tuple[str, str]] = []
        k = 1
        while k < len(s):
            x = s[k]
            if x.up in markers and x.kind in ("word", "sign"):
                access = markers[x.up]
            elif variable(x):
                name = x.up
                while k + 2 < len(s) and s[k + 1].up in ("OF", "IN") and variable(s[k + 2]):
                    name += f" {s[k + 1].up} {s[k + 2].up}"
                    k += 2
                found.append((name, access))
                self.put("use", line, x.up, paragraph, section=section, verb=verb, access=access, qualified=name if name != x.up else None)
            k += 1
        if verb in FLOWING:
            for a, m in found:
                for b, n in found:
                    if a != b and m in ("read", "both") and n in ("write", "both"):
                        self.put("flow", line, a, paragraph, section=section, to=b, via=verb)


def read_source(file: str, text: str | None) -> list[tuple]:
    """The facts of one file; a source that cannot be read gives one `trouble` fact, a null one none."""
    if text is None:
        return []
    try:
        return Reader(file).read(text)
    except (ValueError, IndexError, KeyError, RecursionError) as e:
        return [("trouble", 0, 0, f"{type(e).__name__}: {e}"[:200], None, {}, [])]
