"""Problem 4: generated, minified or bundled, vendored files, and data saved as code.

Copies of third-party code are found by winnowing: the token stream without comments, blanks and letter case is
fingerprinted, and a file is a vendored copy if most of its fingerprints occur in many repositories, unless its notice names
its own. Generated, compressed and data files are told by what they are: a tool's notice in the leading comment,
the shape of bundlers' and compilers' output, lines that repeat one template, a literal that is nearly the whole file, code
without line breaks. A mention of such things in code, strings or later comments counts for nothing.
"""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.llm.spans import Hashes, choices
from codelens.sources.checkpoints import cut, spread

#: Folders that hold third-party code, by convention of package managers, and those that often do.
VENDOR_FOLDERS = ("vendor", "third_party", "thirdparty", "third-party", "node_modules", "bower_components", "godeps", "site-packages", "pods", "carthage")
OUTSIDE_FOLDERS = ("external", "extern", "deps")
#: Folders and file names of tools' output, by convention.
OUTPUT_PATH = re.compile(
    r"(?:^|/)(?:gen|generated|autogen|__generated__|dist|build/out|public/assets)/|(?:_pb2(?:_grpc)?\.pyi?|\.pb\.\w+|_pb\.\w+|[._]generated\.\w+|\.designer\.cs|\.g\.cs|outerclass\.java|grpc\.java|\.pb-c\.[ch]|\.tab\.[ch]|\.yy\.c|_easyjson\.go|_string\.go|_gen\.\w+|\.gen\.\w+|\.(?:min|bundle|chunk)\.\w+)$|(?:^|/)(?:mock|zz)_\w+\.go$",
    re.I,
)
#: Notices that tools put into what they write.
TOOL_NOTICE = re.compile(
    r"\bcode generated\b.*\bdo not edit\b|\b(?:file|source|code|class|module)\b[^.]{0,40}\b(?:was|is|has been)\b[^.]{0,20}\b(?:generated|produced)\b.*\b(?:by|from)\b"
    r"|\bauto-?generated file\b|<auto-?generated|^\W*@generated(?: (?:by|from)\b.*|\W*)$|\b(?:automatically|auto-?) ?(?:generated|created|produced) by\b|\bgenerated by\b.*\bdo not (?:edit|modify)\b|\bdo not (?:edit|modify)\b.*\b(?:generated|produced) (?:by|from)\b",
    re.I,
)
#: Notices on copies of released third-party code.
COPY_NOTICE = re.compile(r"\bvendored from\b|\bbundled copy\b.*\bupstream\b|\bimported unmodified from\b|\(c\) the [\w.-]+ authors \| do not\b|\bcopied verbatim from\b|^\W*@license\b", re.I)
BUNDLE = re.compile(r"\(function\s*\(modules\)\s*\{|__webpack_require__|\bparcelRequire\b|System\.register\(\[|\bvar __(?:awaiter|generator|extends|assign)\w* = \(this && this\.__")
COMPILED = re.compile(r"\b__esModule\b"), re.compile(r"\bswitch\s*\(_a\.label\)")
#: Comments and strings; not the string that marks a compiled module.
SILENT = re.compile(r"""/\*[\s\S]*?\*/|//[^\n]*|^[ \t]*#[^\n]*|(["'])__esModule\1|\"{3}[\s\S]*?\"{3}|'{3}[\s\S]*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`""", re.M)
NOTICE_OF = re.compile(r"Copyright \(c\) (?:the )?([\w.-]+)(?: contributors| authors|\b)|This file is part of ([\w-]+)|^\W*([\w-]+) - all rights reserved", re.M)
COMMENT = re.compile(rb"/\*[\s\S]*?\*/|(?://|^[ \t]*#(?!include|define|if|endif|else)|^[ \t]*--)[^\n]*", re.M)
LITERAL = re.compile(r'"[A-Za-z0-9+/=_\\x-]{200,}"|\'[A-Za-z0-9+/=_\\x-]{200,}\'')
#: Marks of the source line that a tool's output line comes from.
LINE_MARK = re.compile(r"^[ \t]*(?:#line[ \t]+\d+|//line [\w./-]+:\d+|# \d+ \")", re.M)
GRAM, WINDOW = 48, 112


def leading_comment(text: str) -> list[str]:
    """The comment lines before the first line of code."""
    out, inside = [], False
    for line in io.StringIO(text):
        s = line.strip().lstrip("﻿")
        if inside:
            out.append(s)
            inside = "*/" not in s
        elif s.startswith(("//", "--", ";;", "<!--")) or s.startswith("#") and not re.match(r"#\s*(?:include|define|if|line|pragma|region)\b|#!?\[", s):
            out.append(s)
        elif s.startswith("/*"):
            out.append(s)
            inside = "*/" not in s
        elif s and not (s.startswith(("<?php", '"use strict"', "'use strict'")) or s[:1] == "%"):
            break
    return out


def shape(line: str) -> str:
    """The line without names, numbers and string contents."""
    line = re.sub(r"\"[^\"]*\"|'[^']*'", "S", line)
    return re.sub(r"[^\W\d]\w*", "I", re.sub(r"(?<![A-Za-z_])\d[\w.]*", "9", line)).strip()


def repetition(text: str) -> float:
    """The share of lines that repeat the shape of the line a fixed small number of lines before."""
    lines = [s for s in map(str.strip, text.split("\n")) if s and not s.startswith(("//", "#!", "/*", "*", "# "))]
    if len(lines) < 6 or lines[0].startswith("<"):
        return 0.0
    ids: dict[str, int] = {}
    code = np.array([ids.setdefault(shape(s), len(ids)) for s in lines])
    best = 0.0
    for p in range(1, 9):
        if len(code) >= 3 * p + 2:
            best = max(best, float((code[p:] == code[:-p]).mean()))
    return best


def bundled(text: str) -> bool:
    """Whether bundlers' or compilers' marks stand anywhere in the text outside comments and strings."""

    def marked(t: str) -> bool:
        first = COMPILED[0].search(t)
        return bool(BUNDLE.search(t) or first and COMPILED[1].search(t, first.end()))

    return marked(text) and marked(SILENT.sub(lambda m: m[0] if m[1] else " ", text))


def claim_of(path: str | None, content: bytes | None) -> str | None:
    """What a file says of its origin: notice (a copy's notice in the leading comment), place (a package manager's folder), outside (a
    folder that often holds third-party code); None if nothing."""
    folders = {part.lower() for part in (path or "").replace("\\", "/").split("/")[:-1]}
    if content and any(COPY_NOTICE.search(x) for x in leading_comment(content.decode("utf-8", "replace"))):
        return "notice"
    return "place" if folders & set(VENDOR_FOLDERS) else "outside" if folders & set(OUTSIDE_FOLDERS) else None


def kind_of(path: str | None, content: bytes | None) -> str | None:
    """generated, minified, vendored (by a notice or place) or data by the file alone; None for what a person may have written."""
    if claim_of(path, content) in ("notice", "place"):
        return "vendored"
    return made_of(path, content)


def made_of(path: str | None, content: bytes | None) -> str | None:
    """generated, minified or data; None for what a person may have written. Repetition tells a tool's output only together with a
    tool's file name or line marks: people write tables and lists of routes too."""
    p = (path or "").replace("\\", "/")
    if not content:
        return None
    text = content.decode("utf-8", "replace")
    head = leading_comment(text)
    if any(TOOL_NOTICE.search(x) for x in head):
        return "generated"
    size, lines = len(text), text.count("\n") + 1
    output = bool(OUTPUT_PATH.search(p))
    if bundled(text):
        return "minified"
    literal = sum(len(m) for m in LITERAL.findall(text)) if size >= 300 else 0
    if literal > 0.6 * size:
        return "data"
    blanks = sum(map(text.count, " \t\n\r"))
    if size >= 300 and blanks < 0.06 * size and size / lines > 100:
        code = sum(map(text.count, "(){};"))
        return "minified" if code > 0.03 * size else "data"
    if size / lines > 110 and size >= 500 and blanks < 0.12 * size:
        return "minified"
    digits = len(re.findall(r"(?<![A-Za-z_.])\d[\w.]*\s*[,;\s)\]}]", text))
    if digits >= 24:
        number_chars = sum(map(len, re.findall(r"(?<![A-Za-z_.])(?:0x[0-9a-fA-F]+|\d[\w.:-]*)[ \t]*,?", text)))
        if number_chars > 0.55 * (size - text.count("    ") * 4):
            return "data"
    if (output or LINE_MARK.search(text)) and repetition(text) >= 0.5:
        return "generated"
    return None


def fingerprints(contents: list[bytes]) -> list[np.ndarray]:
    """Winnowed fingerprints of each content's normalised tokens; contents shorter than a window have few or none."""
    out = []
    for c in contents:
        t = COMMENT.sub(b"", c or b"").lower().translate(None, b" \t\r\n\f\v")
        n = len(t) - GRAM + 1
        if n < 1:
            out.append(np.zeros(0, np.int64))
            continue
        found = []
        for a in range(0, n, 1 << 19):  # very long files in parts that overlap by a window
            part = np.frombuffer(t[a : a + (1 << 19) + GRAM + WINDOW - 2], np.uint8)
            h = Hashes(part).all(GRAM)
            w = min(WINDOW, len(h))
            p = np.unique(choices(h, w, np.ones(len(h), bool)))
            found.append(h[p].view(np.int64))
        out.append(np.unique(np.concatenate(found)))
    return out


def notices(content: bytes | None) -> list[str]:
    """The projects that the leading comment names as owners."""
    head = "\n".join(leading_comment((content or b"").decode("utf-8", "replace")))
    return [g for m in NOTICE_OF.finditer(head) for g in m.groups() if g]


def classify(df: DataFrame, key: str = "file_id", repo: str = "repo", path: str = "path", content: str = "content", least_repos: int = 5, least_share: float = 0.8) -> DataFrame:
    """(key, kind, evidence) of each generated, minified, vendored or data file, one row per key.

    Repeated rows of a key are copies of one file; null and empty contents are judged by path; null repositories are one.
    Fingerprints are counted over all files: a file is a vendored copy if at least `least_share` of its fingerprints (three at
    least) occur in `least_repos` or more repositories (evidence: fingerprints), unless its notice names its own repository. One
    in a folder for outside code is one if its notice doesn't name its own repository (outside); a copy's notice and a package
    manager's folder are believed (notice, place). Fingerprints of all files stay distributed.
    """
    schema = f"key {df.schema[key].dataType.simpleString()}, repo bigint, kind string, claim string, own boolean, prints array<bigint>"

    def run(batches):
        for b in batches:
            paths, repos, texts = b["path"].tolist(), b["name"].tolist(), b["content"].tolist()
            own = [(r or "") in notices(c) for r, c in zip(repos, texts)]
            yield pd.DataFrame({"key": b["key"], "repo": b["repo"], "kind": [made_of(p, c) for p, c in zip(paths, texts)], "claim": [claim_of(p, c) for p, c in zip(paths, texts)], "own": own, "prints": fingerprints(texts)})

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.xxhash64(repo), F.lit(0)).alias("repo"), F.col(repo).cast("string").alias("name"), F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    rows = cut(spread(rows).mapInPandas(run, schema))
    open_ = rows.where("not own and size(prints) >= 3")
    common = rows.select("repo", F.explode("prints").alias("p")).groupBy("p", "repo").agg(F.lit(1).alias("one")).groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") >= least_repos).select("p")
    hits = open_.select("key", F.size("prints").alias("all"), F.explode("prints").alias("p")).join(common, "p", "left_semi").groupBy("key", "all").agg(F.count_distinct("p").alias("n"))
    hits = hits.where(F.col("n") >= least_share * F.col("all")).select("key", F.lit(True).alias("copied")).distinct()
    files = rows.groupBy("key").agg(F.min("kind").alias("kind"), F.min("claim").alias("claim"), F.max("own").alias("own"))
    found = files.join(hits, "key", "left")
    evidence = F.when(F.col("copied"), "fingerprints").when(F.col("claim").isin("notice", "place") | ~F.col("own"), F.col("claim"))
    found = found.select("key", "kind", evidence.alias("evidence")).where("kind is not null or evidence is not null")
    kind = F.when(F.col("evidence").isNotNull(), "vendored").otherwise(F.col("kind"))
    return found.select(F.col("key").alias(key), kind.alias("kind"), F.coalesce("evidence", F.lit("shape")).alias("evidence"))
