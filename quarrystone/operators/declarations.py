"""What a source file declares and imports, by one scanner for all languages without a parser here.

The scanner drops comments and strings, follows braces, and needs little of a language: how comments look, the words
that declare something, and whether methods are declared by a word or by a header (a type, a name and parameters).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """words: what declares a symbol, with the symbol's type. headers: methods have no such word. braces: bodies are in
    braces, so that last lines and owners are known. hash, slashes, dashes: what starts a comment. quotes: of strings.
    shapes: the type of ``type NAME SHAPE``. indented: declarations below the first column count too."""

    words: dict[str, str]
    headers: bool = False
    braces: bool = True
    hash: bool = False
    slashes: bool = True
    dashes: bool = False
    quotes: str = "\"'"
    shapes: dict[str, str] = field(default_factory=dict)
    indented: bool = True

    def pattern(self) -> re.Pattern[str]:
        skipped = []
        if self.slashes:
            skipped += [r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"]
        if self.hash:
            skipped.append(r"#[^\n]*")
        if self.dashes:
            skipped += [r"--\[\[.*?(?:\]\]|\Z)", r"--[^\n]*"]
        strings = [rf"{q}(?:\\.|[^{q}\\\n])*{q}?" for q in self.quotes]
        return re.compile("(?P<skip>" + "|".join(skipped or ["(?!)"]) + ")|(?P<text>" + "|".join(strings) + r")|(?P<word>[^\W\d][\w$]*)|(?P<end>\n)|(?P<mark>=>|::|[^\s\w])", re.S)


TYPES = {"class": "class", "interface": "interface", "enum": "enum"}
C_LIKE = Language(TYPES | {"record": "class", "struct": "class"}, headers=True)
SHELL = Language({"function": "function"}, hash=True, slashes=False)
POWER = Language({"function": "function", "filter": "function", "class": "class"}, hash=True, slashes=False)
LANGUAGES = {
    ".java": C_LIKE,
    ".cs": C_LIKE,
    ".kt": Language(TYPES | {"object": "class", "fun": "function"}),
    ".scala": Language({"class": "class", "object": "class", "trait": "interface", "def": "function"}),
    ".swift": Language({"class": "class", "struct": "class", "enum": "enum", "protocol": "interface", "func": "function"}, quotes='"'),
    ".php": Language(TYPES | {"trait": "interface", "function": "function"}, hash=True),
    ".go": Language({"func": "function", "type": "type"}, quotes='"`', shapes={"struct": "class", "interface": "interface"}),
    ".rs": Language({"fn": "function", "struct": "class", "enum": "enum", "trait": "interface", "impl": "owner"}, quotes='"'),
    ".py": Language({"class": "class", "def": "function"}, braces=False, hash=True, slashes=False, indented=False),
    ".rb": Language({"class": "class", "module": "module", "def": "function"}, braces=False, hash=True, slashes=False),
    ".lua": Language({"function": "function"}, braces=False, slashes=False, dashes=True),
    ".sh": SHELL, ".bash": SHELL, ".zsh": SHELL, ".ps1": POWER, ".psm1": POWER,
}
PATTERNS = {ext: lang.pattern() for ext, lang in LANGUAGES.items()}
OWNERS = ("class", "interface", "enum", "module", "owner")
NO_HEADER = frozenset("if for while switch catch synchronized lock using return new throw else do foreach fixed await yield case assert".split())


def tokens(text: str, ext: str) -> list[tuple[str, str, int]]:
    """``(class, token, offset)``: words, marks, line ends (also those within comments and strings) and (empty) strings."""
    out = []
    for m in PATTERNS[ext].finditer(text):
        if m.lastgroup in ("skip", "text"):
            out += [("end", "\n", m.start())] * m[0].count("\n")
            if m.lastgroup == "text":
                out.append(("text", "", m.start()))
        else:
            out.append((m.lastgroup, m[0], m.start()))
    return out


def matching(toks: list[tuple[str, str, int]], i: int) -> int:
    """The place of the bracket that closes the one at ``i``."""
    depth = 0
    for j in range(i, len(toks)):
        depth += (toks[j][1] in "([{" and toks[j][0] == "mark") - (toks[j][1] in ")]}" and toks[j][0] == "mark")
        if depth == 0:
            return j
    return len(toks) - 1


def exported(name: str, ext: str, before: set[str]) -> bool:
    """Whether others can use it: in Rust by a visibility modifier, in Go by a capital, else always."""
    return "pub" in before if ext == ".rs" else name[:1].isupper() if ext == ".go" else True


def declared(text: str, ext: str) -> list[dict]:
    """Symbols as ``name, type, start_line, end_line, signature, exported, parent_name``, in their order."""
    lang = LANGUAGES.get(ext)
    if lang is None:
        return keyed(text, ext)
    toks, out, scopes, pending = tokens(text, ext), [], [], None
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    line, fresh, before = 1, True, set()  # fresh: at the start of a line; before: words of the statement so far

    def add(name: str, kind: str, owner: str | None, words: set[str]) -> dict:
        own = owner or next((s["name"] for s in reversed(scopes) if s and s["type"] in OWNERS), None)
        head = text[starts[line - 1] : text.find("\n", starts[line - 1]) if "\n" in text[starts[line - 1] :] else len(text)]
        symbol = {"name": name, "type": "method" if kind == "function" and own else kind, "start_line": line, "end_line": line, "signature": head.strip()[:200].rstrip("{:; "), "exported": exported(name, ext, words), "parent_name": own if kind == "function" else None}
        if kind != "owner":
            out.append(symbol)
        return symbol

    i = 0
    while i < len(toks):
        group, token, at = toks[i]
        following = toks[i + 1] if i + 1 < len(toks) else ("end", "\n", 0)
        previous = toks[i - 1][1] if i else "\n"
        if group == "end":
            line, fresh = line + 1, True
            before = before if lang.braces and lang.headers else set()
            i += 1
            continue
        if token == "{" and group == "mark":
            scopes.append(pending)
            pending, before = None, set()
        elif token == "}" and group == "mark":
            closed = scopes.pop() if scopes else None
            if closed:
                closed["end_line"] = line
            before = set()
        elif token == ";":
            pending, before = None, set()
        elif group == "word" and token in lang.words and previous not in (".", "::", "$") and (lang.indented or at == starts[line - 1] or previous == "async"):
            kind, j, owner = lang.words[token], i + 1, None
            if following[1] == "(" and ext == ".go":  # a receiver
                j = matching(toks, i + 1) + 1
                owner = next((t for g, t, _ in reversed(toks[i + 1 : j]) if g == "word"), None)
            if kind == "owner":  # the type it is for is the last word before the body
                stop = next((k for k in range(j, len(toks)) if toks[k][1] in ("{", ";")), len(toks))
                names = [t for g, t, _ in toks[j:stop] if g == "word" and t not in ("where", "dyn")]
                after = names[names.index("for") + 1 :] if "for" in names else names
                if after:
                    pending = add(after[0], "owner", None, before)
            elif j < len(toks) and toks[j][0] == "word":
                name = toks[j][1]
                while j + 2 < len(toks) and toks[j + 1][1] in (".", ":", "-") and toks[j + 2][0] == "word" and ext in (".lua", ".rb", ".ps1", ".psm1"):
                    name, j = name + toks[j + 1][1] + toks[j + 2][1], j + 2
                if j + 1 < len(toks) and toks[j + 1][1] in ("?", "!") and ext == ".rb":
                    name, j = name + toks[j + 1][1], j + 1
                if kind == "type":
                    kind = lang.shapes.get(toks[j + 1][1]) if j + 1 < len(toks) else None
                if kind and name not in lang.words:
                    pending = add(name, kind, owner, before)
                    i = j
        elif group == "word" and lang.headers and following[1] == "(" and token not in NO_HEADER and (not scopes or (scopes[-1] and scopes[-1]["type"] in OWNERS)) and i and (previous in (">", "]", "?") or (toks[i - 1][0] == "word" and previous not in NO_HEADER) or (scopes and token == scopes[-1]["name"])):
            close = matching(toks, i + 1)
            stop = next((k for k in range(close + 1, len(toks)) if toks[k][1] in ("{", ";", "=>", "=") and toks[k][0] == "mark"), len(toks))
            if stop < len(toks) and toks[stop][1] in ("{", "=>") or (toks[min(stop, len(toks) - 1)][1] == ";" and all(g in ("word", "end", "mark") and t not in (".", "=") for g, t, _ in toks[close + 1 : stop])):
                symbol = add(token, "function", None, before)
                line += sum(g == "end" for g, _, _ in toks[i:stop])
                i = stop
                if toks[stop][1] == "{":
                    pending = symbol
                else:
                    symbol["end_line"] = line
                    i += toks[stop][1] != "{"
                fresh, before = False, set()
                continue
        elif group == "word" and lang.words == SHELL.words and following[1] == "(" and fresh:
            pending = add(token, "function", None, before)
            i += 1
        before.add(token)
        fresh = False
        i += 1
    return out


def keyed(text: str, ext: str) -> list[dict]:
    """Of configuration: named blocks of Terraform, and the names in YAML."""
    out = []
    for number, line in enumerate(text.splitlines(), 1):
        words = line.replace("{", " ").split()
        if ext == ".tf" and words and words[0] in ("resource", "module", "variable", "output", "data") and not line[0].isspace() and len(words) > 1:
            name = words[-1].strip('"')
        elif ext in (".yaml", ".yml") and words[:1] == ["name:"] and len(words) > 1 and len(line) - len(line.lstrip()) in (0, 2):
            name = line.split(":", 1)[1].strip()
        else:
            continue
        out.append({"name": name, "type": "function", "start_line": number, "end_line": number, "signature": line.strip()[:200].rstrip("{ "), "exported": True, "parent_name": None})
    return out


@dataclass(frozen=True)
class Importing:
    """words: what starts an import. quoted: its target is a string. skipped: words between the two. anywhere: within a
    line too. joined: what a target may have besides word characters."""

    words: tuple[str, ...]
    quoted: bool = False
    skipped: tuple[str, ...] = ()
    anywhere: bool = False
    joined: str = "."


C_INCLUDE = Importing(("#include",), quoted=True)
IMPORTING = {
    ".py": Importing(("import", "from")), ".go": Importing(("import",), quoted=True), ".rs": Importing(("use", "mod"), skipped=("pub",), joined=":"),
    ".java": Importing(("import",), skipped=("static",), joined=".*"), ".kt": Importing(("import",)), ".scala": Importing(("import",)), ".swift": Importing(("import",), skipped=("class", "struct", "func")),
    ".cs": Importing(("using",), skipped=("static", "global")), ".c": C_INCLUDE, ".cpp": C_INCLUDE, ".h": C_INCLUDE, ".hpp": C_INCLUDE,
    ".rb": Importing(("require", "require_relative"), quoted=True), ".php": Importing(("use", "require", "require_once", "include", "include_once"), joined="\\"), ".lua": Importing(("require",), quoted=True, anywhere=True),
    ".tf": Importing(("source",), quoted=True), ".yaml": Importing(("$ref:",), quoted=True, anywhere=True), ".yml": Importing(("$ref:",), quoted=True, anywhere=True), ".clj": Importing(("(:require",), joined=".-/", anywhere=True),
}


def imported(text: str, ext: str) -> list[tuple[str, int]]:
    """``(target, line)`` of each different import; separators of namespaces become slashes where they are backslashes."""
    rule = IMPORTING.get(ext)
    found: dict[str, int] = {}
    block = False  # in a Go block of imports
    for number, line in enumerate(text.splitlines() if rule else (), 1):
        rest = line.strip()
        if block:
            block = not rest.startswith(")")
            targets = [quoted(rest)] if block else []
        else:
            for word in rule.skipped:
                rest = rest.removeprefix(word + " ").lstrip()
            at = next((p for w in rule.words if (p := place(rest, w, rule.anywhere)) is not None), None)
            if at is None:
                continue
            rest = rest[at:].lstrip(" \t(=[")
            if ext == ".go" and line.strip().removeprefix("import").strip().startswith("("):
                block = ")" not in line
                targets = [quoted(x) for x in line.split(";")]
            elif rule.quoted or rest[:1] in "\"'":
                targets = [quoted(rest) or (rest.split() or [""])[0] if ext in (".yaml", ".yml") else quoted(rest)]
            else:
                while (first := (rest.split() or [""])[0]) in rule.skipped:
                    rest = rest[len(first) :].lstrip()
                parts = rest.split(",") if ext == ".py" and line.strip().startswith("import") else [rest]
                targets = [leading(p.strip(), rule.joined) for p in parts]
        for target in targets:
            if target:
                found.setdefault(target.replace("\\", "/"), number)
    return list(found.items())


def place(line: str, word: str, anywhere: bool) -> int | None:
    """Where what follows a word in a line begins."""
    at = line.find(word) if anywhere else 0 if line.startswith(word) else -1
    end = at + len(word)
    return end if at >= 0 and (end == len(line) or not (line[end].isalnum() or line[end] == "_")) else None


def quoted(text: str) -> str:
    """The first string of a line, also one in angle brackets."""
    m = re.search(r"[\"'<]([^\"'<>]+)[\"'>]", text)
    return m[1] if m else ""


def leading(text: str, joined: str) -> str:
    """The name a text begins with, without what joins it to nothing."""
    name = re.match(rf"[\w{re.escape(joined)}]*", text)[0]
    return name.removesuffix(".*").strip(":.") if name.strip(".") else name
