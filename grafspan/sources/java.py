"""A tolerant reader of Java and Kotlin declarations: bytes of a file to flat records.

A scanner finds tokens; declarations are then read by matching braces, so that an error in one body
does not lose the rest of the file. The reader never raises on bad source: it sets parse_error and
returns what it found. It runs inside ``mapInPandas``, one file at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .. import vocabulary as V

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>->|::|\?\.|\?:|@|[^\s\w])""",
    re.DOTALL | re.VERBOSE,
)
MODIFIERS = set("public protected private static final abstract default synchronized native strictfp transient volatile sealed non override open internal data inner lateinit suspend companion const inline operator infix tailrec external value actual expect vararg enum".split())
PAIR = {"(": ")", "[": "]", "{": "}"}
NOT_CALLS = set("if for while switch catch return throw new synchronized try assert do else case super this instanceof when fun".split())


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Unit:
    filename: str
    package: str = ""
    imports: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)
    members: list[dict] = field(default_factory=list)
    fields: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    scope: list[dict] = field(default_factory=list)
    parse_error: bool = False


class Reader:
    def __init__(self, source: bytes, filename: str):
        self.text = source.decode("utf-8", "replace")
        self.unit = Unit(filename)
        self.kotlin = filename.endswith(".kt")
        self.t = [Token(m.lastgroup, m[0], m.start(), m.end()) for m in TOKEN.finditer(self.text) if m.lastgroup not in ("space", "comment")]
        self.close = self._pairs()
        self._bytes = None if self.text.isascii() else [0]
        if self._bytes is not None:
            for ch in self.text:
                self._bytes.append(self._bytes[-1] + len(ch.encode()))
        self._lines = [i for i, ch in enumerate(self.text) if ch == "\n"]

    # --- places ---

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in PAIR:
                stack.append(i)
            elif t.kind == "op" and t.text in ")]}":
                while stack and PAIR[self.t[stack[-1]].text] != t.text:
                    out[stack.pop()] = i
                    self.unit.parse_error = True
                if stack:
                    out[stack.pop()] = i
        if stack:
            self.unit.parse_error = True
        for i in stack:
            out[i] = len(self.t) - 1
        return out

    def byte(self, at: int) -> int:
        return at if self._bytes is None else self._bytes[at]

    def line(self, at: int) -> int:
        import bisect

        return bisect.bisect_left(self._lines, at) + 1

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts

    def name_at(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name"

    def qualified(self, i: int) -> tuple[str, int]:
        """A dotted name from i on, and the place after it."""
        parts = []
        while self.name_at(i):
            parts.append(self.t[i].text)
            if self.is_(i + 1, ".") and (self.name_at(i + 2) or self.is_(i + 2, "*")):
                i += 2
                if self.is_(i, "*"):
                    parts.append("*")
                    return ".".join(parts), i + 1
            else:
                return ".".join(parts), i + 1
        return ".".join(parts), i

    def generics(self, i: int) -> int:
        """The place after ``<...>``, or i."""
        if not self.is_(i, "<"):
            return i
        depth = 0
        while i < len(self.t):
            if self.t[i].text == "<":
                depth += 1
            elif self.t[i].text == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif self.t[i].text in (";", "{", "}"):
                return i
            i += 1
        return i

    def type_ref(self, i: int) -> tuple[str, int]:
        """Simple name of a type (generics, arrays, qualifiers and null marks dropped), and the place after it."""
        while self.is_(i, "@"):
            _, i = self.annotation(i)
        name, j = self.qualified(i)
        j = self.generics(j)
        while self.is_(j, ".") and self.name_at(j + 1):
            name, j = self.qualified(j + 1)
            j = self.generics(j)
        while self.is_(j, "[") and self.is_(j + 1, "]"):
            j += 2
        if self.is_(j, "?") and self.kotlin:
            j += 1
        if self.is_(j, ".") and self.is_(j + 1, ".") and self.is_(j + 2, "."):
            j += 3
        return name.rsplit(".", 1)[-1], j

    def annotation(self, i: int) -> tuple[dict, int]:
        j = i + 1
        if self.kotlin and self.name_at(j) and self.is_(j + 1, ":"):  # a use-site target
            j += 2
        name, j = self.qualified(j)
        args = ""
        if self.is_(j, "(") and j in self.close:
            end = self.close[j]
            args, j = self.text[self.t[j].end : self.t[end].start], end + 1
        return {"name": name.rsplit(".", 1)[-1], "args": args.strip()}, j

    def modifiers(self, i: int) -> tuple[list[str], list[dict], int]:
        mods, anns = [], []
        while i < len(self.t):
            if self.is_(i, "@") and not self.is_(i + 1, "interface"):
                a, i = self.annotation(i)
                anns.append(a)
            elif self.t[i].text in MODIFIERS and not (self.t[i].text in ("enum", "data", "open", "value", "inner") and not self.name_at(i + 1)) and not (self.t[i].text == "enum" and not self.kotlin):
                mods.append(self.t[i].text)
                i += 1
                if self.is_(i, "-") and self.is_(i + 1, "sealed"):
                    i += 2
            else:
                return mods, anns, i
        return mods, anns, i

    # --- declarations ---

    def read(self) -> Unit:
        try:
            self._unit()
        except Exception:  # bad source
            self.unit.parse_error = True
        return self.unit

    def _unit(self) -> None:
        i, u, tops = 0, self.unit, []
        while i < len(self.t):
            at = i
            mods, anns, i = self.modifiers(i)
            if self.is_(i, "package"):
                u.package, i = self.qualified(i + 1)
            elif self.is_(i, "import"):
                i = self._import(i + 1)
            elif (kind := self._type_kind(i)) is not None:
                i = self._type(i, kind, mods, anns, "", at)
            elif self.kotlin and self.is_(i, "fun", "val", "var"):
                tops.append((at, i, mods, anns))
                i = self._skip_kotlin(i)
            else:
                i = max(i, at) + 1
        if tops:  # functions outside of types live on a facade
            stem = u.filename.rsplit("/", 1)[-1].removesuffix(".kt")
            fqn = f"{u.package}.{stem[:1].upper()}{stem[1:]}Kt".lstrip(".")
            self._add_type(fqn.rsplit(".", 1)[-1], "class", fqn, "", [], [], [], [], 0, len(self.text))
            for at, i, mods, anns in tops:
                self._kotlin_member(i, mods + ["static"], anns, fqn, at)

    def _import(self, i: int) -> int:
        static = self.is_(i, "static")
        name, j = self.qualified(i + static)
        alias = None
        if self.is_(j, "as"):
            alias, j = self.t[j + 1].text, j + 2
        wild = name.endswith(".*")
        fqn = name.removesuffix(".*")
        kind = ("static_" if static else "") + ("wildcard" if wild else "explicit")
        self.unit.imports.append({"kind": kind, "fqn": fqn, "name": "" if wild else alias or fqn.rsplit(".", 1)[-1], "ordinal": len(self.unit.imports)})
        return j + self.is_(j, ";")

    def _type_kind(self, i: int) -> str | None:
        if self.is_(i, "@") and self.is_(i + 1, "interface"):
            return "annotation"
        if self.is_(i, "class", "interface", "enum", "object") and self.name_at(i + 1):
            return {"object": "class"}.get(self.t[i].text, self.t[i].text) if self.t[i].text != "object" or self.kotlin else None
        if self.is_(i, "object") and self.kotlin and self.is_(i + 1, "{"):
            return "class"
        if self.is_(i, "record") and self.name_at(i + 1) and (self.is_(i + 2, "(", "<")):
            return "record"
        return None

    def _add_type(self, name: str, kind: str, fqn: str, outer: str, mods: list, anns: list, ext: list, imp: list, start: int, end: int) -> dict:
        row = {"name": name, "kind": kind, "fqn": fqn, "outer_fqn": outer, "modifiers": mods, "annotations": [a["name"] for a in anns], "annotation_args": [a["args"] for a in anns], "extends": ext, "implements": imp,
               "start_byte": self.byte(start), "end_byte": self.byte(end), "start_line": self.line(start), "end_line": self.line(max(start, end - 1))}
        self.unit.types.append(row)
        return row

    def _list_of_types(self, i: int) -> tuple[list[str], int]:
        out = []
        while True:
            name, i = self.type_ref(i)
            if name:
                out.append(name)
            if self.kotlin and self.is_(i, "(") and i in self.close:
                out[-1] = out[-1] + "()"
                i = self.close[i] + 1
            if self.kotlin and self.is_(i, "by"):
                _, i = self.qualified(i + 1)
            if not self.is_(i, ","):
                return out, i
            i += 1

    def _type(self, i: int, kind: str, mods: list, anns: list, outer: str, at: int) -> int:
        i += 2 if kind == "annotation" and not self.kotlin else 1
        name = self.t[i].text if self.name_at(i) else "Companion"
        i += self.name_at(i)
        i = self.generics(i)
        if self.kotlin:
            kind = "annotation" if "annotation" in mods else "record" if "data" in mods else "enum" if "enum" in mods else kind
        fqn = f"{outer or self.unit.package}.{name}".lstrip(".")
        ext, imp, params = [], [], None
        while self.kotlin and (self.t[i].text in MODIFIERS or self.is_(i, "@", "constructor")):
            i = self.annotation(i)[1] if self.is_(i, "@") else i + 1
        if self.is_(i, "(") and i in self.close:
            params, i = (i, self.close[i]), self.close[i] + 1
        if self.kotlin and self.is_(i, ":"):
            supers, i = self._list_of_types(i + 1)
            ext = [s[:-2] for s in supers if s.endswith("()") and kind != "interface"]
            imp = [s.removesuffix("()") for s in supers if not s.endswith("()") or kind == "interface"]
        while self.is_(i, "extends", "implements", "permits"):
            word = self.t[i].text
            names, i = self._list_of_types(i + 1)
            ext += names if word == "extends" else []
            imp += names if word == "implements" else []
        body = i if self.is_(i, "{") and i in self.close else None
        end = self.close[body] if body is not None else max(i - 1, 0)
        start = self.t[at].start if at < len(self.t) else 0
        self._add_type(name, kind, fqn, outer, mods, anns, ext, imp, start, self.t[end].end)
        has = False
        if params and (kind == "record" or self.kotlin):
            has = self._primary(params, fqn, name, start)
        if body is not None:
            has |= self._body(body, fqn, name, kind)
        if kind in ("class", "enum") and not has and not {a["name"] for a in anns} & set(V.LOMBOK_CONSTRUCTORS):
            self._member("<init>", "constructor", fqn, [], [], [], start, start, None)
        return end + 1

    def _primary(self, params: tuple[int, int], fqn: str, name: str, start: int) -> bool:
        found = self._params(*params)
        for p in found:
            self.unit.fields.append({"type_fqn": fqn, "name": p[0], "type": p[1], "annotations": [], "modifiers": ["final"], "ordinal": len(self.unit.fields)})
            if not self.kotlin:
                self._member(p[0], "method", fqn, ["public"], [], [], start, start, None)
        self._member("<init>", "constructor", fqn, [], [], found, start, start, None)
        return True

    def _params(self, i: int, end: int) -> list[tuple[str, str]]:
        out, i = [], i + 1
        while i < end:
            _, _, i = self.modifiers(i)
            if self.kotlin:
                while self.is_(i, "val", "var"):
                    i += 1
                name, kind = self.t[i].text, ""
                if self.is_(i + 1, ":"):
                    kind, i = self.type_ref(i + 2)
            else:
                kind, i = self.type_ref(i)
                name = self.t[i].text if self.name_at(i) else ""
                i += 1
            if name and kind:
                out.append((name, kind))
            while i < end and not self.is_(i, ","):
                i = self.close.get(i, i) + 1 if self.t[i].text in PAIR else i + 1
            i += 1
        return out

    def _body(self, body: int, fqn: str, name: str, kind: str) -> bool:
        i, end, made = body + 1, self.close[body], False
        if kind == "enum":
            i = self._constants(i, end)
        while i < end:
            at = i
            mods, anns, i = self.modifiers(i)
            if i >= end:
                break
            if self.is_(i, "{"):
                i = self.close[i] + 1
            elif (inner := self._type_kind(i)) is not None:
                i = self._type(i, inner, mods, anns, fqn, at)
            elif self.kotlin:
                made |= self.is_(i, "constructor")
                self._kotlin_member(i, mods, anns, fqn, at)
                i = self._skip_kotlin(i)
            else:
                i, ctor = self._java_member(i, mods, anns, fqn, name, kind, at, end)
                made |= ctor
        return made

    def _constants(self, i: int, end: int) -> int:
        while i < end and not self.is_(i, ";"):
            if self.t[i].text in PAIR and i in self.close:
                i = self.close[i]
            i += 1
        return i + 1

    def _java_member(self, i: int, mods: list, anns: list, fqn: str, name: str, kind: str, at: int, end: int) -> tuple[int, bool]:
        i = self.generics(i)
        start = self.t[at].start
        if self.name_at(i) and self.t[i].text == name and (self.is_(i + 1, "(") or (kind == "record" and self.is_(i + 1, "{"))):
            if self.is_(i + 1, "{"):
                return self.close[i + 1] + 1, False
            return self._method(i, "<init>", "constructor", mods, anns, fqn, start), True
        type_name, j = self.type_ref(i)
        if not type_name or not self.name_at(j):
            return max(i, at) + 1, False
        if self.is_(j + 1, "("):
            return self._method(j, self.t[j].text, "method", mods, anns, fqn, start), False
        while True:
            self.unit.fields.append({"type_fqn": fqn, "name": self.t[j].text, "type": type_name, "annotations": [a["name"] for a in anns], "modifiers": mods, "ordinal": len(self.unit.fields)})
            j += 1
            while j < end and not self.is_(j, ",", ";"):
                j = self.close.get(j, j) + 1 if self.t[j].text in PAIR else j + 1
            if not (self.is_(j, ",") and self.name_at(j + 1)):
                return j + 1, False
            j += 1

    def _method(self, i: int, name: str, kind: str, mods: list, anns: list, fqn: str, start: int) -> int:
        opening = i + 1
        closing = self.close.get(opening, opening)
        params = self._params(opening, closing)
        j = closing + 1
        while j < len(self.t) and not self.is_(j, "{", ";", "="):
            j += 1
        body = j if self.is_(j, "{") and j in self.close else None
        if body is None and self.is_(j, "=") and not self.kotlin or self.is_(j, "default"):
            while j < len(self.t) and not self.is_(j, ";"):
                j += 1
        end = self.close[body] if body is not None else min(j, len(self.t) - 1)
        self._member(name, kind, fqn, mods, anns, params, start, self.t[end].end, (body, end) if body is not None else None)
        return end + 1

    def _member(self, name: str, kind: str, fqn: str, mods: list, anns: list, params: list, start: int, end: int, body: tuple[int, int] | None) -> None:
        signature = f"{name}({','.join(t for _, t in params)})"
        own = f"{fqn}#{signature}"
        self.unit.members.append({"type_fqn": fqn, "name": name, "kind": kind, "signature": signature, "fqn": own, "modifiers": mods, "annotations": [a["name"] for a in anns], "annotation_args": [a["args"] for a in anns],
                                  "param_names": [n for n, _ in params], "param_types": [t for _, t in params], "start_byte": self.byte(start), "end_byte": self.byte(end), "start_line": self.line(start), "end_line": self.line(max(start, end - 1))})
        for n, (p, t) in enumerate(params):
            self.unit.scope.append({"member_fqn": own, "name": p, "type": t, "rank": 1, "ordinal": n})
        explicit = False
        if body is not None:
            explicit = self._calls(body[0], body[1], own, fqn)
        if kind == "constructor" and not explicit:
            self._call(own, "super", "<init>", 0, start, False)

    # --- Kotlin ---

    def _skip_kotlin(self, i: int) -> int:
        """The place after a function or property: its block, or its last line."""
        line, k = None, i
        while k < len(self.t):
            t = self.t[k]
            if t.text == "{" and k in self.close:
                return self.close[k] + 1
            if t.text in ("(", "["):
                k = self.close.get(k, k)
            now = self.line(self.t[k].end)
            nxt = self.line(self.t[k + 1].start) if k + 1 < len(self.t) else now + 1
            if nxt > now and not self.is_(k, "=", ".", ",", "->", ":", "?.", "?:") and not self.is_(k + 1, ".", "{", "=", ":", "?.", "?:") and k > i:
                return k + 1
            if self.is_(k + 1, "}"):
                return k + 1
            k += 1
        del line
        return k

    def _kotlin_member(self, i: int, mods: list, anns: list, fqn: str, at: int) -> None:
        start, after = self.t[at].start, self._skip_kotlin(i)
        last = min(after, len(self.t)) - 1
        if self.is_(i, "constructor") or self.is_(i, "fun"):
            j = self.generics(i + 1) if self.is_(i, "fun") else i
            name = "<init>" if self.is_(i, "constructor") else ""
            if not name:
                while self.name_at(j) and self.is_(j + 1, ".", "<"):  # a receiver type
                    j = self.generics(j + 1) + 1 if self.is_(j + 1, "<") else j + 2
                name = self.t[j].text if self.name_at(j) else ""
            if not name or not self.is_(j + 1, "("):
                return
            closing = self.close.get(j + 1, j + 1)
            body = next((k for k in range(closing, last + 1) if self.is_(k, "{") and k in self.close), None)
            if body is None:
                body = next((k for k in range(closing, last + 1) if self.is_(k, "=")), None)
            span = (body, self.close.get(body, last) if self.is_(body, "{") else last + 1) if body is not None else None
            self._member(name, "constructor" if name == "<init>" else "method", fqn, mods, anns, self._params(j + 1, closing), start, self.t[last].end, span)
        elif self.is_(i, "val", "var") and self.name_at(i + 1):
            name = self.t[i + 1].text
            kind = self.type_ref(i + 3)[0] if self.is_(i + 2, ":") else ""
            self.unit.fields.append({"type_fqn": fqn, "name": name, "type": kind, "annotations": [a["name"] for a in anns], "modifiers": mods + (["final"] if self.is_(i, "val") else []), "ordinal": len(self.unit.fields)})
            kept = name.startswith("is") and name[2:3].isupper()
            self._member(name if kept else f"get{name[:1].upper()}{name[1:]}", "method", fqn, mods, [], [], start, start, None)
            if self.is_(i, "var"):
                self._member(f"set{name[2:] if kept else name[:1].upper() + name[1:]}", "method", fqn, mods, [], [("value", kind)], start, start, None)

    # --- bodies ---

    def _call(self, caller: str, receiver: str, callee: str, args: int, at: int, in_lambda: bool, text: str = "") -> None:
        self.unit.calls.append({"caller_fqn": caller, "receiver": receiver, "callee": callee, "arg_count": args, "line": self.line(at), "byte": self.byte(at), "in_lambda": in_lambda, "args": text[:400]})

    def _arguments(self, opening: int) -> int:
        end = self.close.get(opening, opening)
        if end == opening + 1:
            return 0
        n, k = 1, opening + 1
        while k < end:
            if self.t[k].text in PAIR and k in self.close:
                k = self.close[k]
            elif self.t[k].text == "<" and self.name_at(k - 1) and self.t[k - 1].text[:1].isupper():
                k = max(k, self.generics(k) - 1)
            elif self.t[k].text == ",":
                n += 1
            k += 1
        return n

    def _receiver(self, dot: int, low: int) -> str:
        """Text of the expression before a dot."""
        k, opens = dot - 1, {b: a for a, b in self.close.items()}
        while k > low:
            if self.t[k].text in (")", "]") and k in opens:
                k = opens[k] - 1
                if self.name_at(k) or self.t[k].text in (")", "]"):
                    continue
                k += 1
                break
            if self.name_at(k) or self.t[k].kind in ("string", "number"):
                if self.is_(k - 1, ".", "?.") and k - 2 > low:
                    k -= 2
                    continue
                if self.is_(k - 1, "new"):
                    k -= 1
                break
            k += 1
            break
        return self.text[self.t[max(k, low + 1)].start : self.t[dot].start].strip()

    def _lambdas(self, low: int, high: int) -> list[tuple[int, int]]:
        out = []
        for k in range(low, high):
            if self.is_(k, "->"):
                if self.is_(k + 1, "{"):
                    out.append((k, self.close.get(k + 1, high)))
                else:
                    e = k + 1
                    while e < high and not self.is_(e, ",", ";", ")", "}"):
                        e = self.close.get(e, e) + 1 if self.t[e].text in PAIR else e + 1
                    out.append((k, e))
        return out

    def _calls(self, low: int, high: int, caller: str, host: str) -> bool:
        """Call sites and local variables of a body; True if a constructor calls another one first."""
        explicit, k, lambdas, n = False, low + 1, self._lambdas(low, high), 0
        while k < high:
            t = self.t[k]
            within = any(a < k < b for a, b in lambdas)
            if t.text == "new" and self.name_at(k + 1):
                name, j = self.type_ref(k + 1)
                if self.is_(j, "(") and j in self.close:
                    self._call(caller, name, "<init>", self._arguments(j), t.start, within)
                    after = self.close[j] + 1
                    if self.is_(after, "{") and after in self.close:
                        self._anonymous(after, name, host, t.start)
                        inner = self._calls(j, self.close[j], caller, host)
                        explicit |= inner and False
                        k = self.close[after] + 1
                        continue
                    k = j + 1
                    continue
                k = j
                continue
            if t.text in ("this", "super") and self.is_(k + 1, "("):
                explicit = True
                self._call(caller, t.text, "<init>", self._arguments(k + 1), t.start, within)
                k += 2
                continue
            if t.text == "::" and (self.name_at(k + 1)):
                callee = "<init>" if self.is_(k + 1, "new") else self.t[k + 1].text
                self._call(caller, self._receiver(k, low), callee, -1, self.t[k + 1].start, within)
                k += 2
                continue
            if t.kind == "name" and t.text not in NOT_CALLS:
                j = self.generics(k + 1) if self.is_(k + 1, "<") and self.is_(self.generics(k + 1), "(") and self.is_(k - 1, ".") else k + 1
                trailing = self.kotlin and self.is_(k + 1, "{") and self.is_(k - 1, ".", "?.")
                if (self.is_(j, "(") and j in self.close) or trailing:
                    receiver = self._receiver(k - 1, low) if self.is_(k - 1, ".", "?.") else ""
                    text = "" if trailing else self.text[self.t[j].end : self.t[self.close[j]].start]
                    if self.kotlin and not receiver and t.text[:1].isupper():
                        self._call(caller, t.text, "<init>", self._arguments(j), t.start, within, text)
                    else:
                        self._call(caller, receiver, t.text, 1 if trailing else self._arguments(j), t.start, within, text)
                elif self.kotlin and self.is_(k - 1, "val", "var"):
                    kind = self.type_ref(k + 2)[0] if self.is_(k + 1, ":") else self.t[k + 2].text if self.is_(k + 1, "=") and self.name_at(k + 2) and self.t[k + 2].text[:1].isupper() and self.is_(k + 3, "(") else ""
                    if kind:
                        self.unit.scope.append({"member_fqn": caller, "name": t.text, "type": kind, "rank": 2, "ordinal": (n := n + 1)})
                elif not self.kotlin and (t.text[:1].isupper() or t.text == "var") and self.is_(k - 1, ";", "{", "}", "(", "final", ")", ":"):
                    kind, j = self.type_ref(k)
                    if self.name_at(j) and self.is_(j + 1, "=", ";", ":") and not self.is_(j, "instanceof"):
                        if kind == "var":
                            kind = self.type_ref(j + 3)[0] if self.is_(j + 2, "new") else ""
                        if kind:
                            self.unit.scope.append({"member_fqn": caller, "name": self.t[j].text, "type": kind, "rank": 2, "ordinal": (n := n + 1)})
                        k = j
                        continue
            k += 1
        return explicit

    def _anonymous(self, body: int, base: str, host: str, start: int) -> None:
        fqn = f"{host}.<anon:{self.byte(start)}>"
        local = {t["name"]: t["kind"] for t in self.unit.types}
        face = local.get(base) == "interface" or (base not in local and base in ANONYMOUS_INTERFACES)
        self._add_type(fqn.rsplit(".", 1)[-1], "class", fqn, host, [], [], [] if face else [base], [base] if face else [], start, self.t[self.close[body]].end)
        self._body(body, fqn, "", "class")


#: Supertypes of anonymous classes that count as interfaces if the file does not declare them.
ANONYMOUS_INTERFACES = set(
    "Runnable Callable Comparable Iterable Iterator AutoCloseable Closeable Flushable Readable Appendable Cloneable Serializable Externalizable "
    "InvocationHandler ThreadFactory PrivilegedAction PrivilegedExceptionAction Comparator Consumer BiConsumer Supplier Function BiFunction UnaryOperator "
    "BinaryOperator Predicate BiPredicate IntConsumer LongConsumer DoubleConsumer IntFunction LongFunction DoubleFunction IntPredicate LongPredicate "
    "DoublePredicate IntSupplier LongSupplier DoubleSupplier ToIntFunction ToLongFunction ToDoubleFunction Stream BaseStream Collector Observer Observable "
    "List Set Map Queue Deque Collection EventListener ActionListener MouseListener KeyListener WindowListener RowMapper ResultSetExtractor "
    "PreparedStatementCreator CallableStatementCallback".split()
)


def read(source: bytes, filename: str) -> Unit:
    return Reader(source, filename).read()


_TEXTS = "array<string>"
SCHEMA = (
    "filename string, package string, parse_error boolean, "
    "imports array<struct<kind: string, fqn: string, name: string, ordinal: int>>, "
    f"types array<struct<name: string, kind: string, fqn: string, outer_fqn: string, modifiers: {_TEXTS}, annotations: {_TEXTS}, annotation_args: {_TEXTS}, extends: {_TEXTS}, implements: {_TEXTS}, start_byte: bigint, end_byte: bigint, start_line: bigint, end_line: bigint>>, "
    f"members array<struct<type_fqn: string, name: string, kind: string, signature: string, fqn: string, modifiers: {_TEXTS}, annotations: {_TEXTS}, annotation_args: {_TEXTS}, param_names: {_TEXTS}, param_types: {_TEXTS}, start_byte: bigint, end_byte: bigint, start_line: bigint, end_line: bigint>>, "
    f"fields array<struct<type_fqn: string, name: string, type: string, annotations: {_TEXTS}, modifiers: {_TEXTS}, ordinal: int>>, "
    "calls array<struct<caller_fqn: string, receiver: string, callee: string, arg_count: int, line: bigint, byte: bigint, in_lambda: boolean, args: string>>, "
    "scope array<struct<member_fqn: string, name: string, type: string, rank: int, ordinal: int>>"
)


def parsed(files):  # noqa: ANN001, ANN201
    """files (filename, content: binary) to one row of SCHEMA each."""

    def run(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in batches:
            rows = [read(bytes(c), f) for f, c in zip(b["filename"], b["content"], strict=True)]
            yield pd.DataFrame([{k: getattr(u, k) for k in ("filename", "package", "parse_error", "imports", "types", "members", "fields", "calls", "scope")} for u in rows])

    return files.select("filename", "content").mapInPandas(run, SCHEMA)
