"""Reading functions, classes, imports, calls and comments out of source files, in Arrow-batched Python workers.

Python is parsed with its own parser; a file that it rejects, and all other languages, go through a lexical scanner over text without
comments and strings. The scanner finds definitions by their heads and bodies by brackets, `end` or indentation, so its measures
of complexity count keywords, not syntax nodes: an approximation where a language has other branching forms.
"""

from __future__ import annotations

import ast
import re
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.sources.checkpoints import spread

#: Languages by extension.
EXTENSIONS = {"go": "go", "rs": "rust", "py": "python", "pyi": "python", "ts": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "tsx": "tsx", "jsx": "jsx", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "cs": "csharp", "rb": "ruby", "rake": "ruby", "gemspec": "ruby", "php": "php", "sh": "bash", "bash": "bash"}
#: Keywords that branch, that nest, and that branch without nesting, by language.
DECISIONS = {"go": "if for select switch case", "rust": "if match for while loop", "python": "if for while with try elif except", "ruby": "if unless while until for case when rescue elsif", "bash": "if for while case elif", "c": "if for while do switch case", "java": "if for while do switch catch", "csharp": "if for foreach while do switch catch", "javascript": "if for while do switch catch case", "typescript": "if for while do switch catch case"}
NESTING = {k: [w for w in v.split() if w not in ("case", "when", "elif", "elsif")] for k, v in DECISIONS.items()}
FLAT = {"elif", "elsif", "else", "case", "when"}
HEADS = {
    "go": r"^[ \t]*func\s+(?:\([^)]*\)\s*)?(?P<n>\w+)", "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+(?P<n>\w+)",
    "javascript": r"(?:\bfunction\s*\*?\s*(?P<n>\w+)|^[ \t]*(?:static\s+|async\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(?P<m>\w+))\s*\([^;{}]*\)\s*(?::[^;{}=]+)?\{",
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|internal|override|virtual|async|inline|unsigned|const|struct)\s+)*[\w<>\[\],.*&:]+[ \t*&]+(?P<n>(?!if\b|for\b|while\b|switch\b|return\b|catch\b)\w+)\s*\([^;{}]*\)\s*(?:throws[\w\s,.]+)?\{",
    "bash": r"^[ \t]*(?:function\s+)?(?P<n>[\w-]+)\s*\(\)\s*\{", "ruby": r"^[ \t]*def\s+(?:self\.)?(?P<n>\w+[?!=]?)", "python": r"^[ \t]*(?:async\s+)?def\s+(?P<n>\w+)",
}
HEADS |= {"typescript": HEADS["javascript"], "csharp": HEADS["java"], "c": HEADS["java"]}
CLASSES = {"python": r"^[ \t]*class\s+(?P<n>\w+)", "ruby": r"^[ \t]*(?:class|module)\s+(?P<n>\w+)", "go": r"^[ \t]*type\s+(?P<n>\w+)\s+struct", "rust": r"^[ \t]*(?:pub\s+)?(?:struct|enum|impl)\s+(?P<n>\w+)"}
CLASS = r"\b(?:class|interface|struct)\s+(?P<n>\w+)"
IMPORTS = {
    "go": r'^[ \t]*import\s+(?:\w+\s+)?"([^"]+)"|^[ \t]+"([\w./-]+)"[ \t]*$', "rust": r"^[ \t]*(?:pub\s+)?use\s+([^;]+);|^[ \t]*(?:pub\s+)?mod\s+(\w+)\s*;", "python": r"^[ \t]*from\s+([\w.]+)\s+import|^[ \t]*import\s+([\w.]+)",
    "javascript": r"""(?:^[ \t]*import\b[^'"\n]*|\brequire\()['"]([^'"]+)['"]""", "java": r"^[ \t]*import\s+(?:static\s+)?([\w.*]+)\s*;", "csharp": r"^[ \t]*using\s+([\w.]+)\s*;", "c": r'^[ \t]*#[ \t]*include\s*[<"]([^>"]+)[>"]',
    "ruby": r"""^[ \t]*require(?:_relative)?\s*\(?['"]([^'"]+)['"]""", "bash": r"^[ \t]*(?:source|\.)[ \t]+([^\s;]+)",
}
IMPORTS["typescript"] = IMPORTS["javascript"]
_STRIP = {
    "#": re.compile(r"\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|#[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"),
    "/": re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+?'|`[^`]*`"),
}


def stripped(text: str, language: str) -> str:
    """The text with comments and strings as blanks, of the same length and lines."""
    p = _STRIP["#" if language in ("python", "ruby", "bash") else "/"]
    return p.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _body_end(clean: str, at: int, language: str) -> int:
    if language == "python":
        lines = clean[at:].split("\n")
        indent = len(lines[0]) - len(lines[0].lstrip())
        end = at + len(lines[0])
        for line in lines[1:]:
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            end += len(line) + 1
        return min(end, len(clean))
    if language == "ruby":
        line = clean[clean.rfind("\n", 0, at) + 1 : at + 1]
        m = re.compile(rf"^{re.match(r'[ \t]*', line).group()}end\b", re.M).search(clean, at)
        return m.end() if m else len(clean)
    a = clean.find("{", at)
    if a < 0:
        return len(clean)
    depth = 0
    for m in re.compile("[{}]").finditer(clean, a):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(clean)


def measure(body: str, language: str) -> tuple[int, int, int]:
    """PAR-6 to PAR-8: cyclomatic, cognitive and nesting of a function's text without strings (its head included)."""
    words = DECISIONS.get(language, DECISIONS["java"]).split()
    nest = set(NESTING.get(language, NESTING["java"]))
    logic = len(re.findall(r"&&|\|\|", body))
    cyc = 1 + len(re.findall(rf"\b(?:{'|'.join(words)})\b", body)) + (0 if language in ("python", "ruby") else logic)
    cognitive = logic + (len(re.findall(r"\b(?:and|or)\b", body)) if language in ("python", "ruby") else 0)
    most, open_at = 0, []
    if language in ("python", "ruby", "bash"):
        for line in body.split("\n")[1:]:
            s = line.strip()
            if not s:
                continue
            indent = len(line) - len(line.lstrip())
            while open_at and open_at[-1] >= indent:
                open_at.pop()
            w = re.match(r"\w*", s).group()
            if w in FLAT:
                cognitive += 1
                open_at.append(indent)
            elif w in nest:
                cognitive += 1 + len(open_at)
                open_at.append(indent)
                most = max(most, len(open_at))
    else:
        depth, waiting = 0, False
        for m in re.finditer(r"\b\w+\b|[{};]", body[max(body.find("{"), 0) + 1 :]):
            t = m.group()
            if t == "else":
                cognitive += 1
            elif t in nest:
                cognitive += 1 + depth
                waiting = True
            elif t == "{":
                open_at.append(waiting)
                depth += waiting
                most = max(most, depth)
                waiting = False
            elif t == "}" and open_at:
                depth -= open_at.pop()
    return cyc, cognitive, most


def _python_functions(text: str) -> list[dict] | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out = []
    lines = text.split("\n")
    for f in ast.walk(tree):
        if not isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        cyc, cognitive, most = 1, 0, 0
        todo = [(c, 0) for c in f.body]
        while todo:
            n, depth = todo.pop()
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda | ast.ClassDef):
                continue
            inner = depth
            if isinstance(n, ast.If | ast.For | ast.AsyncFor | ast.While | ast.With | ast.AsyncWith | ast.Try | ast.ExceptHandler | ast.IfExp | ast.comprehension):
                cyc += 1
            if isinstance(n, ast.If | ast.For | ast.AsyncFor | ast.While | ast.Try | ast.ExceptHandler | ast.With):
                cognitive += 1 + depth
                inner = depth + 1
                most = max(most, inner)
            if isinstance(n, ast.BoolOp):
                cognitive += len(n.values) - 1
            todo.extend((c, inner) for c in ast.iter_child_nodes(n))
        calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(f) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
        out.append({"name": f.name, "start_line": f.lineno, "end_line": f.end_lineno, "signature": lines[f.lineno - 1].strip()[:120], "exported": not f.name.startswith("_"), "cyclomatic": cyc, "cognitive": cognitive, "nesting": most, "calls": calls})
    return out


def functions(text: str, language: str) -> list[dict]:
    """PAR-2 and GRA-12: the functions of a file with measures and called names."""
    if language == "python" and (out := _python_functions(text)) is not None:
        return out
    head = HEADS.get(language)
    if not head:
        return []
    clean, out = stripped(text, language), []
    for m in re.finditer(head, clean, re.M):
        name = m.groupdict().get("n") or m.groupdict().get("m")
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        end = _body_end(clean, start, language)
        body = clean[start:end]
        cyc, cognitive, most = measure(body, language)
        inner = body[len(m.group()) :]
        calls = sorted({c for c in re.findall(r"([A-Za-z_]\w*)!?\s*\(", inner) if c not in ("if", "for", "while", "switch", "catch", "return", "match", "function")})
        exported = {"go": name[:1].isupper(), "rust": "pub" in m.group(), "java": "public" in m.group(), "csharp": "public" in m.group(), "c": "static" not in m.group()}.get(language, "export" in text[max(0, start - 16) : start] or language in ("ruby", "bash"))
        line = clean.count("\n", 0, start) + 1
        out.append({"name": name, "start_line": line, "end_line": line + body.count("\n"), "signature": text[start:].split("\n", 1)[0].strip()[:120], "exported": bool(exported), "cyclomatic": cyc, "cognitive": cognitive, "nesting": most, "calls": calls})
    return out


def classes(text: str, language: str, found: list[dict] | None = None) -> list[dict]:
    """PAR-3: the classes of a file with methods and fields (found: its functions, where known)."""
    clean, out = stripped(text, language), []
    found = functions(text, language) if found is None else found
    for m in re.finditer(CLASSES.get(language, CLASS), clean, re.M):
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        end = _body_end(clean, start, language)
        a, b = clean.count("\n", 0, start) + 1, clean.count("\n", 0, end) + 1
        inside = [f for f in found if a <= f["start_line"] <= b]
        fields = sorted(set(re.findall(r"\b(?:self|this)\s*\.\s*(\w+)\b(?!\s*\()|@(\w+)", clean[start:end])))
        out.append({"name": m.group("n"), "start_line": a, "end_line": b, "methods": [f["name"] for f in inside], "fields": sorted({x or y for x, y in fields}), "wmc": sum(f["cyclomatic"] for f in inside), "calls": sorted({c for f in inside for c in f["calls"]})})
    return out


def imports(text: str, language: str) -> list[tuple[str, int]]:
    """PAR-4: imported names and lines."""
    p = IMPORTS.get(language)
    return [(next(g for g in m.groups() if g), text.count("\n", 0, m.end()) + 1) for m in re.finditer(p, text, re.M)] if p else []


def stubs(text: str, language: str, known: list[dict] | None = None) -> list[tuple[str, str, int, str]]:
    """TXT-8 to TXT-10: (kind, severity, line, function): functions that don't do their work.

    not_implemented over empty_body over elision; a weak elision counts only beside one of the others, and elision in an
    empty body is part of it.
    """
    from codelens.operators.text import ELISION, NOT_IMPLEMENTED, WEAK_ELISION

    out, lines = [], text.split("\n")
    todo = re.compile(r"\b(?:todo|unimplemented)!\s*\(|\braise\s+NotImplementedError\b|\bNotImplementedException\b|\bUnsupportedOperationException\b|(?:throw\s+new\s+\w*Error|panic!?|raise|errors\.New)\s*\(?\s*[\"']([^\"']*)[\"']")
    mark = "#" if language in ("python", "ruby", "bash") else "//"
    for f in functions(text, language) if known is None else known:
        body = lines[f["start_line"] - 1 : f["end_line"]]
        found, comments = {}, [(i, s.split(mark, 1)[1]) for i, s in enumerate(body) if mark in s]
        for i, s in enumerate(body):
            m = todo.search(s)
            if m and (m.group(1) is None or re.search(NOT_IMPLEMENTED, m.group(1))):
                found.setdefault("not_implemented", i)
        clean = stripped("\n".join(body), language)
        inner = clean[clean.find("{") + 1 : clean.rfind("}")] if "{" in clean and language not in ("python", "ruby") else "\n".join(clean.split("\n")[1:])
        if not re.sub(r"\b(?:pass|end|return(?: (?:None|nil|null))?)\b|\.\.\.|[\s;]", "", inner):
            found.setdefault("empty_body", 0)
        strong = [i for i, c in comments if re.search(ELISION, c)]
        weak = [i for i, c in comments if re.search(WEAK_ELISION, c)]
        if strong and "empty_body" not in found:
            found["elision"] = strong[0]
        elif weak and found and "empty_body" not in found:
            found["elision"] = weak[0]
        kind = next((k for k in ("not_implemented", "empty_body", "elision") if k in found), None)
        if kind:
            out.append((kind, "high" if kind == "not_implemented" else "medium", f["start_line"] + found[kind], f["name"]))
    return out


FUNCTION = "struct<name:string,start_line:int,end_line:int,signature:string,exported:boolean,cyclomatic:int,cognitive:int,nesting:int,calls:array<string>>"
KLASS = "struct<name:string,start_line:int,end_line:int,methods:array<string>,fields:array<string>,wmc:int,calls:array<string>>"
SCHEMA = f"path string, language string, lines int, functions array<{FUNCTION}>, classes array<{KLASS}>, imports array<struct<name:string,line:int>>, stubs array<struct<kind:string,severity:string,line:int,function:string>>"


def language_column(path):
    """SRC-4: the language of a path's extension, whatever its case; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def extract(files: DataFrame, most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """PAR-1: one row per file (path, content) of a known language of at most `most_bytes` (SRC-7), with all that is read out of it.

    Undecodable bytes are replaced; repeated paths count once; null contents are empty.
    """

    def run(batches):
        for b in batches:
            rows = []
            for path, language, content in zip(b["path"], b["language"], b["content"]):
                text = (content or b"").decode("utf-8", "replace").replace("\r\n", "\n").removeprefix("﻿")
                found = functions(text, language)
                rows.append((path, language, text.count("\n") + bool(text and not text.endswith("\n")), found, classes(text, language, found), [{"name": n, "line": i} for n, i in imports(text, language)],
                             [dict(zip(("kind", "severity", "line", "function"), x)) for x in stubs(text, language, found)]))
            yield pd.DataFrame(rows, columns=["path", "language", "lines", "functions", "classes", "imports", "stubs"])

    d = files.select("path", language_column(F.col("path")).alias("language"), F.col("content").cast("binary").alias("content"))
    d = d.where(F.col("language").isNotNull() & (F.coalesce(F.octet_length("content"), F.lit(0)) <= most_bytes))
    return spread(d).mapInPandas(run, SCHEMA).dropDuplicates(["path"])
