"""Symbols, imports and modules of source files, taken from their text.

Python files are parsed by Python's own grammar, scripts (TypeScript, JavaScript) by a scanner that follows brackets,
strings and comments, other languages by that of ``declarations``. Files stream through Arrow batches and are never
shuffled.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import paths as P
from quarrystone.operators.declarations import declared, imported

# The word before the name of a package or namespace, by extension.
MODULE_WORDS = {".cs": "namespace", ".java": "package", ".kt": "package", ".scala": "package", ".php": "namespace"}
ROUTE_DECORATORS = {"Get", "Post", "Put", "Patch", "Delete"}


def module_of(path: Column, text: Column) -> Column:
    """The package or namespace a file declares, with dots; null if none."""
    word = F.create_map(*(F.lit(x) for pair in MODULE_WORDS.items() for x in pair))[P.extension(path)]
    lines = F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), lambda line: F.split_part(F.ltrim(line), F.lit(" "), F.lit(1)) == word)
    name = F.regexp_extract(F.get(lines, F.lit(0)), r"^\s*\w+\s+([\w.\\]+)", 1)
    return F.nullif(F.trim(F.replace(name, F.lit("\\"), F.lit(".")), F.lit(".")), F.lit(""))


def symbol(name: str, kind: str, start: int, end: int, signature: str, exported: bool = True, parent: str | None = None, decorators: list[str] = [], tags: list[str] = []) -> dict:  # noqa: B006
    return {"name": name, "type": kind, "start_line": start, "end_line": end, "signature": signature[:600], "exported": exported, "parent_name": parent, "decorators": list(decorators), "tags": list(tags)}


def python_symbols(text: str) -> list[dict] | None:
    """Classes and functions, nested ones with their class; None if the text doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, out = text.splitlines(), []
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, parent = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent else "function"
                names = [d.func if isinstance(d, ast.Call) else d for d in child.decorator_list]
                decorators = [d.attr if isinstance(d, ast.Attribute) else d.id for d in names if isinstance(d, ast.Attribute | ast.Name)]
                line = lines[child.lineno - 1].strip() if child.lineno <= len(lines) else child.name
                out.append(symbol(child.name, kind, child.lineno, child.end_lineno or child.lineno, line[:200], True, parent, decorators))
                stack.append((child, child.name if isinstance(child, ast.ClassDef) else parent))
            else:
                stack.append((child, parent))
    return sorted(out, key=lambda s: (s["start_line"], s["name"]))


QUIET = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
DECLARED = re.compile(r"(?P<exported>export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?P<word>class|interface|function|enum)\s*\*?\s+(?P<name>[A-Za-z_$][\w$]*)")
ARROW = re.compile(r"(?P<exported>export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^={\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)")
METHOD = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^<>{}]*>)?\(", re.M)
NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "constructor", "super", "new", "await", "throw", "typeof"}
SCRIPT_IMPORT = re.compile(r"^[ \t]*(?P<kind>import|export)\s+(?P<type>type\s+)?(?P<clause>[^;'\"]*?)\s*(?:from\s+)?(?P<q>['\"])(?P<spec>[^'\"\n]+)(?P=q)", re.M)


def blanked(text: str) -> str:
    """The text with the contents of strings and comments as spaces, so that brackets left are code."""
    return QUIET.sub(lambda m: "".join("\n" if c == "\n" else " " for c in m[0]), text)


def closing(code: str, at: int) -> int:
    """Where the block that opens at or after ``at`` closes; the end of the line if none opens before a semicolon."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i
        elif c == ";" and depth == 0:
            return i
    return len(code) - 1


def decorators_before(code: str, at: int) -> list[str]:
    """The decorators, with arguments of any length, that stand right before ``at`` in blanked code."""
    names: list[str] = []
    while True:
        end = len(code[:at].rstrip())
        if end and code[end - 1] == ")":
            depth = 1
            while end > 1 and depth:
                end -= 1
                depth += (code[end - 1] == ")") - (code[end - 1] == "(")
            end = len(code[: end - 1].rstrip())
        start = end
        while start and (code[start - 1].isalnum() or code[start - 1] in "_$."):
            start -= 1
        if start in (0, end) or code[start - 1] != "@":
            return names[::-1]
        names.append(code[start:end].split(".")[-1])
        at = start - 1


def body_start(code: str, start: int, stop: int) -> int:
    """Where the body of a declaration begins: its first brace outside brackets of any kind; if there is none, the
    semicolon that ends it, or ``stop``."""
    depth = 0
    for i in range(start, stop):
        c = code[i]
        if c == ";" and depth == 0:
            return i
        if c == "{" and depth == 0:
            if code[start:i].rstrip().endswith(":"):  # an object type
                depth += 1
                continue
            return i
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and code[i - 1] != "="):
            depth = max(depth - 1, 0)
    return stop


def script_symbols(text: str) -> list[dict]:
    """Classes with their methods, interfaces, functions and functions held in variables."""
    code, out, spans = blanked(text), [], []
    line_of = lambda i: text.count("\n", 0, i) + 1
    head = lambda i, j: " ".join(x.strip() for x in text[i : body_start(code, i, j)].splitlines() if x.strip())
    for m in DECLARED.finditer(code):
        end, word, name = closing(code, body_start(code, m.end(), len(code))), m["word"], m["name"]
        decorators = decorators_before(code, m.start())
        kind = {"class": "class", "interface": "interface", "enum": "enum", "function": "function"}[word]
        tags = []
        if word == "class":
            kind = "controller" if "Controller" in decorators or name.endswith("Controller") else "module" if "Module" in decorators or name.endswith("Module") else "service" if "Injectable" in decorators or name.endswith("Service") else "class"
            if kind == "class" and re.match(r"\s*(?:<[^{]*>)?\s*extends\s+(?:React\s*\.\s*)?(?:Pure)?Component\b", code[m.end() :]):
                kind, tags = "component", ["component"]
            spans.append((m.start(), end, name, kind))
        elif word == "function":
            kind, tags = function_kind(name, text[m.start() : end])
        out.append(symbol(name, kind, line_of(m.start()), line_of(end), head(m.start(), end), bool(m["exported"]), None, decorators, tags))
    for m in ARROW.finditer(code):
        end = closing(code, m.end())
        kind, tags = function_kind(m["name"], text[m.start() : end])
        out.append(symbol(m["name"], kind, line_of(m.start()), line_of(end), head(m.start(), end), bool(m["exported"]), None, (), tags))
    for start, stop, owner, _ in spans:
        opened = code.find("{", start)
        depth_at = opened + 1
        for m in METHOD.finditer(code, depth_at, stop):
            if m["name"] in NO_METHOD or code.count("{", depth_at, m.start()) != code.count("}", depth_at, m.start()):
                continue
            brace = body_start(code, m.start("name"), stop)
            if code[brace : brace + 1] != "{":
                continue
            end, decorators = closing(code, brace), decorators_before(code, m.start())
            kind = "routeHandler" if ROUTE_DECORATORS & set(decorators) else "method"
            out.append(symbol(m["name"], kind, line_of(m.start("name")), line_of(end), head(m.start(), end), False, owner, decorators))
    return sorted(out, key=lambda s: (s["start_line"], s["name"]))


def function_kind(name: str, body: str) -> tuple[str, list[str]]:
    if re.match(r"use[A-Z0-9]", name):
        return "hook", ["hook"]
    if name[:1].isupper() and re.search(r"<[A-Za-z][\w.]*[\s/>]|<>", body):
        return "component", ["component"]
    return "function", []


def script_imports(text: str) -> list[tuple[str, list[str], bool, int]]:
    """``(specifier, local names, type only, line)`` of imports and of exports from other files."""
    out = []
    for m in SCRIPT_IMPORT.finditer(text):
        clause = m["clause"].strip()
        if m["kind"] == "export" and "from" not in m[0][: m.start("q") - m.start()]:
            continue
        names = []
        braces = re.search(r"\{([^}]*)\}", clause)
        for part in (braces[1].split(",") if braces else []):
            words = part.replace("type ", "").split()
            if words:
                names.append(words[-1])
        plain = re.sub(r"\{[^}]*\}", "", clause)
        for part in plain.split(","):
            words = part.replace("*", "").split()
            if words and words != ["from"]:
                names.insert(0, [w for w in words if w not in ("as", "from")][-1])
        out.append((m["spec"], names, bool(m["type"]), text.count("\n", 0, m.start()) + 1))
    return out


def extract(text: str, path: str) -> tuple[list[dict], list[dict]]:
    """Symbols and imports of one file."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1].lower()
    ext = name[name.rfind(".") :] if "." in name else ""
    if ext in P.SCRIPT_EXTENSIONS or ext in (".mjs", ".cjs"):
        symbols = script_symbols(text)
        imports = [{"ord": i, "specifier": s, "imported_names": n, "is_type_only": t, "line": line} for i, (s, n, t, line) in enumerate(script_imports(text))]
        return symbols, imports
    symbols = python_symbols(text) if ext in (".py", ".pyw") else None
    if symbols is None:
        symbols = [symbol(x["name"], x["type"], x["start_line"], x["end_line"], x["signature"], x["exported"], x["parent_name"]) for x in declared(text, ext)]
    imports = [{"ord": i, "specifier": s, "imported_names": [], "is_type_only": False, "line": line} for i, (s, line) in enumerate(imported(text, ext))]
    return symbols, imports


SYMBOLS = "array<struct<name string, type string, start_line int, end_line int, signature string, exported boolean, parent_name string, decorators array<string>, tags array<string>>>"
IMPORTS = "array<struct<ord int, specifier string, imported_names array<string>, is_type_only boolean, line int>>"
_symbol = pa.struct([("name", pa.string()), ("type", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("exported", pa.bool_()), ("parent_name", pa.string()), ("decorators", pa.list_(pa.string())), ("tags", pa.list_(pa.string()))])
_import = pa.struct([("ord", pa.int32()), ("specifier", pa.string()), ("imported_names", pa.list_(pa.string())), ("is_type_only", pa.bool_()), ("line", pa.int32())])


def index_files(files: DataFrame) -> DataFrame:
    """``(path, module, symbols, imports)`` of every file with a path; a null text has none of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [extract(t or "", p) for p, t in zip(paths, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([s for s, _ in found], pa.list_(_symbol)), pa.array([i for _, i in found], pa.list_(_import))], names=["path", "module", "symbols", "imports"])

    rows = files.where("path is not null").select("path", "text", module_of(F.col("path"), F.col("text")).alias("module"))
    return rows.mapInArrow(run, f"path string, module string, symbols {SYMBOLS}, imports {IMPORTS}")


def symbols_of(indexed: DataFrame) -> DataFrame:
    rows = indexed.select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return rows.withColumn("id", F.concat_ws(":", "path", "name", "start_line", "type"))


def imports_of(indexed: DataFrame) -> DataFrame:
    return indexed.select("path", F.explode("imports").alias("i")).select("path", "i.*")
