"""Code inside literals: where it is, and literals too nested for a regular expression.

`code_in` gives the pieces of code in one literal's holes. Where holes hold literals of the same quotes again, the lexer's
regular expressions see no literal; `rewritten` then walks the file and puts plain literals in their places once the code in
their holes has been parsed. Markup becomes an array of the expressions in it.
"""

from __future__ import annotations

import re

#: What stands for a document that begins on the next line.
HEREDOC = "\x05"
CLOSING = {"(": ")", "[": "]", "{": "}"}


def heredocs(lang, tokens: list[str]) -> list[str]:
    """Tokens with each embedded document as one, followed by the tokens of the rest of the line that announced it."""
    out = []
    for t in tokens:
        m = re.match(r"<<[-~]?[ \t]*(?:(['\"`])([^\n]*?)\1|\\?(\w+))", t) if t.startswith("<<") and "\n" in t else None
        if m is None:
            out.append(t)
            continue
        line = t[m.end() : t.index("\n")]
        quoted = m.group(1) == "'" or lang.name == "bash" and m.group(1) is not None
        out.append(HEREDOC if quoted or holes_ok(lang, t[t.index("\n") :]) else "\x01")
        out += [x.group() for x in lang.many.finditer(line)]
    return out


def holes_ok(lang, body: str) -> bool:
    if lang.name == "bash" or "#{" not in body:
        return True
    found = _holes(lang, body, "#{")
    return found is not None and all(map(lang.fragment, found))


def code_in(lang, t: str) -> list[str] | None:
    """The code in the holes of a literal; None if a hole doesn't end."""
    name = lang.name
    if name == "python":
        m = re.match(r"[a-zA-Z]*", t)
        if "f" not in m.group().lower() and "t" not in m.group().lower():
            return []
        q = 3 if t[m.end() : m.end() + 3] in ('"""', "'''") and len(t) >= m.end() + 6 else 1
        return _fields(lang, t[m.end() + q : -q], "r" in m.group().lower())
    if name in ("javascript", "typescript"):
        return _holes(lang, t[1:-1], "${") if t[0] == "`" and "${" in t else []
    if name == "csharp":
        if "$" not in t[: len(t) - len(t.lstrip("$@"))]:
            return []
        if '"""' in t:
            return []  # holes of raw literals are as wide as their prefix
        body = t.lstrip("$@")[1:-1]
        return _fields(lang, body, True)
    if name == "ruby":
        return _holes(lang, t, "#{") if "#{" in t and t[0] != "'" and not t.startswith(("%w", "%i", "%q")) else []
    if name == "bash":
        return _commands(t)
    return []


def _end(lang, text: str, at: int, stops: str) -> int:
    """Where the code that begins at `at` meets one of the stops outside brackets; -1 if it doesn't."""
    open_: list[str] = []
    while at < len(text):
        if (m := START[lang.name].match(text, at)) and (end := literal_end(lang, text, m)) > 0:
            at = end
            continue
        m = lang.many.search(text, at)
        if m is None:
            return -1
        t = m.group()
        if not open_ and t[0] in stops and len(t) == 1:
            return m.start()
        if t in CLOSING:
            open_.append(CLOSING[t])
        elif t in (")", "]", "}"):
            if not open_ or open_.pop() != t:
                return -1
        at = m.end()
    return -1


def _holes(lang, body: str, opener: str) -> list[str] | None:
    out, at = [], 0
    while True:
        m = re.compile(r"\\[\s\S]|" + re.escape(opener)).search(body, at)
        if m is None:
            return out
        at = m.end()
        if m.group() != opener:
            continue
        end = _end(lang, body, at, "}")
        if end < 0:
            return None
        out.append(body[at:end])
        at = end + 1


def _fields(lang, body: str, raw: bool, spec: bool = False) -> list[str] | None:
    """The expressions of replacement fields: {expression!conversion:format}, with fields in formats; {{ and }} are text."""
    out, at = [], 0
    python = lang.name == "python"
    while True:
        m = re.compile(r"[{}]" if raw else r"\\N\{[^}]*\}|\\[^{}]|[{}]").search(body, at)
        if m is None:
            return out
        at = m.end()
        if m.group() not in "{}":
            continue
        if body[at : at + 1] == m.group() and not spec:
            at += 1
            continue
        if m.group() == "}":
            return None
        end = _end(lang, body, at, "}:!" if python else "}:,")
        while python and 0 < end and body[end] == "!" and body[end + 1 : end + 2] == "=":
            end = _end(lang, body, end + 2, "}:!")
        if end < 0:
            return None
        code = body[at:end].rstrip()
        if python and code.endswith("=") and code[-2:-1] not in ("=", "!", "<", ">"):
            code = code[:-1]
        if not code.strip():
            return None
        out.append("(" + code + "\n)" if python and not code.lstrip().startswith("yield") else code)
        if body[end] == "!":
            m = re.compile(r"![ ]*[rsa][ ]*(?=[:}])").match(body, end)
            if m is None:
                return None
            end = m.end()
        if body[end] == ",":
            end = _end(lang, body, end + 1, "}:")
            if end < 0:
                return None
        if body[end] == ":":
            depth, at = 1, end + 1
            while at < len(body) and depth:
                depth += {"{": 1, "}": -1}.get(body[at], 0)
                at += 1
            if depth:
                return None
            inner = _fields(lang, body[end + 1 : at - 1], True, True) if python else []
            if inner is None:
                return None
            out += inner
        else:
            at = end + 1


def _commands(t: str) -> list[str] | None:
    """Command and process substitutions of a word, outermost ones only; arithmetic is left alone."""
    out, at = [], 0
    find = re.compile(r"\\[\s\S]|'[^']*'|\$\(\(|[$<>]\(|`")
    double = False
    while at < len(t):
        c = t[at]
        if c == '"':
            double = not double
            at += 1
            continue
        m = find.match(t, at)
        if m is None or double and m.group()[0] in "'<>":
            at += 1
            continue
        g = m.group()
        at = m.end()
        if g in ("$(", "<(", ">("):
            end = command_end(t, at)
            if end < 0:
                return None
            out.append(t[at:end])
            at = end + 1
        elif g == "$((":
            depth = 2
            while at < len(t) and depth:
                depth += {"(": 1, ")": -1}.get(t[at], 0)
                at += 1
        elif g == "`":
            end = at
            while end < len(t) and t[end] != "`":
                end += 2 if t[end] == "\\" else 1
            if end >= len(t):
                return None
            out.append(re.sub(r"\\([`\\$])", r"\1", t[at:end]))
            at = end + 1
    return out


def command_end(text: str, at: int) -> int:
    """Where the bracket of a substitution that has begun ends."""
    depth = 1
    find = re.compile(r"\\[\s\S]|'[^']*'|\$\(|[()]|\"|(?<![^\s;&|()])#[^\n]*|`[^`]*`|\bcase\b|\besac\b|[^\s;&|()\"'`$\\]+|.", re.S)
    cases = 0
    while at < len(text):
        m = find.match(text, at)
        g = m.group()
        if g == '"':
            at = quote_end(text, m.end())
            if at < 0:
                return -1
            continue
        if g in ("$(", "("):
            depth += 1
        elif g == "case":
            cases += 1
        elif g == "esac":
            cases -= 1
        elif g == ")":
            if not (cases and depth == 1):
                depth -= 1
                if not depth:
                    return m.start()
        at = m.end()
    return -1


def quote_end(text: str, at: int) -> int:
    """Behind the end of a double-quoted string of a shell."""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == '"':
            return at + 1
        elif text.startswith("$(", at) and not text.startswith("$((", at):
            end = command_end(text, at + 2)
            if end < 0:
                return -1
            at = end + 1
        else:
            at += 1
    return -1


#: How literals with holes begin.
START = {
    "python": re.compile(r"(?<![\w'\"])(?:[rR]?[fFtT]|[fFtT][rR])(\"\"\"|'''|\"|')"),
    "javascript": re.compile("(`)"), "typescript": re.compile("(`)"),
    "csharp": re.compile(r"(?:\$@|@\$|\$)(\")(?!\"\")"),
    "ruby": re.compile(r"([\"`])"),
    "bash": re.compile("(\")"),
}
for _n in ("c", "java", "go", "rust"):
    START[_n] = re.compile(r"(?!)")


def literal_end(lang, text: str, m) -> int:
    """Behind the end of the literal that m begins, holes of any depth included; -1 if there is none or a hole is broken."""
    quote, at = m.group(1), m.end()
    name = lang.name
    opener = {"javascript": "${", "typescript": "${", "ruby": "#{"}.get(name, "{")
    raw = name == "python" and "r" in m.group().lower() or name == "csharp" and "@" in m.group()
    while at < len(text):
        if text.startswith(quote, at):
            if name == "csharp" and raw and text.startswith('""', at):
                at += 2
                continue
            return at + len(quote)
        c = text[at]
        if c == "\\" and not (raw and name == "csharp"):
            at += 2
        elif c == "\n" and len(quote) == 1 and name in ("python", "csharp") and not raw:
            return -1
        elif text.startswith(opener, at):
            if opener == "{" and text.startswith("{{", at):
                at += 2
                continue
            at += len(opener)
            end = _end(lang, text, at, "}:!," if opener == "{" else "}")
            while 0 < end and text[end] != "}":
                if text[end] == ":":  # a format, with holes of its own
                    depth, end = 1, end + 1
                    while end < len(text) and depth:
                        depth += {"{": 1, "}": -1}.get(text[end], 0)
                        end += 1
                    end -= 1
                    break
                end = _end(lang, text, end + 1, "}:!,")
            if end < 0 or end >= len(text):
                return -1
            at = end + 1
        else:
            at += 1
    return -1


def rewritten(lang, text: str):
    """Other spellings of the file that mean the same to the grammar: nested literals as plain ones, markup as arrays."""
    name = lang.name
    if name in ("javascript", "typescript"):
        if "`" in text or re.search(r"<[A-Za-z>]", text):
            out = Markup(lang, text).code(0, "")
            if out is not None and out[0] != text:
                yield out[0]
    elif name in ("python", "csharp", "ruby") and START[name].search(text):
        out, at, done = [], 0, 0
        while token := lang.many.search(text, at):
            at = token.end()
            m = START[name].match(text, token.start())
            if m is None:
                continue
            end = literal_end(lang, text, m)
            if end < 0:
                return
            body = text[m.end() : end - len(m.group(1))]
            found = _holes(lang, body, "#{") if name == "ruby" else _fields(lang, body, name == "csharp" or "r" in m.group().lower())
            if found is None or not all(lang.fragment(f) or any(map(lang.fragment, rewritten(lang, f))) for f in found):
                return
            out += [text[done : token.start()], '""']
            at = done = end
        yield "".join(out) + text[done:]
    elif name == "bash" and '"' in text:
        out, at, done = [], 0, 0
        plain = re.compile(r"\\[\s\S]|'[^']*'|(?<![^\s;&|()])#[^\n]*|<<-?[ \t]*(['\"\\]?)(\w+)\1[^\n]*\n(?:[\s\S]*?\n)??[ \t]*\2(?=\n|\Z)|\"|\$\((?!\()|.", re.S)
        while at < len(text):
            m = plain.match(text, at)
            at = m.end()
            if m.group() not in ('"', "$("):
                continue
            end = quote_end(text, at) if m.group() == '"' else command_end(text, at) + 1
            if end <= 0:
                return
            found = _commands(text[m.start() : end])
            if found is None or not all(lang.fragment(f) or any(map(lang.fragment, rewritten(lang, f))) for f in found):
                return
            out += [text[done : m.start()], '""']
            at = done = end
        yield "".join(out) + text[done:]


class Markup:
    """Walks code with elements of markup and templates; elements become arrays of the expressions in them."""

    NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
    SPACE = re.compile(r"(?:\s|/\*[\s\S]*?\*/|//[^\n]*\n)*")

    def __init__(self, lang, text: str):
        self.lang, self.text = lang, text

    def code(self, at: int, stop: str):
        """(code, where it stops): up to a closing bracket that it did not open (if a stop is given) or the end of the text."""
        text, out, open_, before = self.text, [], [], ""
        while at < len(text):
            if text[at] == "`":
                got = self.template(at + 1)
                if got is None:
                    return None
                out.append(got[0])
                at, before = got[1], "s"
                continue
            m = self.lang.many.search(text, at)
            if m is None:
                break
            if "`" in text[at : m.start() + 1] and text[m.start()] == "`":
                out.append(text[at : m.start()])
                at = m.start()
                continue
            t = m.group()
            if t == "<" and (before in ("", "return", "default", "case", "else", "do", "await", "yield", "=>") or before[-1] in "(,=?:&|{[;}!"):
                got = self.element(m.start())
                if got is not None:
                    out += [text[at : m.start()], got[0]]
                    at, before = got[1], "s"
                    continue
            if stop and not open_ and t == stop:
                return "".join(out) + text[at : m.start()], m.end()
            if t in CLOSING:
                open_.append(CLOSING[t])
            elif t in (")", "]", "}") and (not open_ or open_.pop() != t):
                return None
            out.append(text[at : m.end()])
            if not t.startswith(("//", "/*")) and t != "\n":
                before = t
            at = m.end()
        return None if stop else ("".join(out) + text[at:], len(text))

    def template(self, at: int):
        holes = []
        while at < len(self.text):
            c = self.text[at]
            if c == "`":
                return "`" + "".join("${" + h + "}" for h in holes) + "`" if not holes else "(" + ",".join(h or "(" for h in holes) + ")", at + 1
            if self.text.startswith("${", at):
                got = self.code(at + 2, "}")
                if got is None:
                    return None
                holes.append(got[0])
                at = got[1]
            else:
                at += 2 if c == "\\" else 1
        return None

    def element(self, at: int):
        text, holes = self.text, []
        at = self.SPACE.match(text, at + 1).end()
        m = self.NAME.match(text, at)
        name, at = (m.group(), m.end()) if m else ("", at)
        if name and (m := re.compile(r"<[^<>=]*(?:<[^<>]*>[^<>]*)*>").match(text, at)):  # type arguments
            at = m.end()
        while True:
            at = self.SPACE.match(text, at).end()
            if text.startswith("/>", at):
                return "[" + ",".join(holes) + "]", at + 2
            if text.startswith(">", at):
                at += 1
                break
            if not name:
                return None
            if text.startswith("{", at):
                got = self.code(at + 1, "}")
                if got is None or not got[0].strip().startswith("..."):
                    return None
                holes.append(got[0])
                at = got[1]
                continue
            m = self.NAME.match(text, at)
            if m is None:
                return None
            at = self.SPACE.match(text, m.end()).end()
            if not text.startswith("=", at):
                continue
            at = self.SPACE.match(text, at + 1).end()
            q = text[at : at + 1]
            if q in ('"', "'") and q:
                at = text.find(q, at + 1) + 1
                if not at:
                    return None
            elif q == "{":
                got = self.code(at + 1, "}")
                if got is None:
                    return None
                holes.append(got[0])
                at = got[1]
            elif q == "<":
                got = self.element(at)
                if got is None:
                    return None
                holes.append(got[0])
                at = got[1]
            else:
                return None
        while at < len(text):
            c = text[at]
            if c == "{":
                got = self.code(at + 1, "}")
                if got is None:
                    return None
                if re.sub(r"/\*[\s\S]*?\*/|//[^\n]*", "", got[0]).strip():
                    holes.append(got[0])
                at = got[1]
            elif c == "<":
                m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at)
                if m:
                    return ("[" + ",".join(holes) + "]", m.end()) if m.group(1) == name else None
                got = self.element(at)
                if got is None:
                    return None
                holes.append(got[0])
                at = got[1]
            elif c in ">}":
                return None
            else:
                at += 1
        return None


def branches(text: str) -> list[str] | None:
    """The file without directives' alternatives: as it is, with the first branch of each condition, and with the last one;
    None if conditions are not closed or not open."""
    directive = re.compile(r"[ \t]*#[ \t]*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b")
    stack: list[list[bool]] = []
    first, last, alternatives = [], [], False
    lines = text.split("\n")
    # which branch is the last of its condition is known at its end: walk once to count them
    counts, open_ = {}, []
    for no, line in enumerate(lines):
        m = directive.match(line)
        if not m:
            continue
        w = m.group(1)
        if w.startswith("if"):
            open_.append([no, 1, False])
        elif not open_:
            return None
        elif w == "endif":
            start, n, _ = open_.pop()
            counts[start] = n
        else:
            if open_[-1][2]:
                return None
            open_[-1][1] += 1
            open_[-1][2] = w == "else"
            alternatives = True
    if open_:
        return None
    if not alternatives:
        return [text]
    where: list[list[int]] = []
    for no, line in enumerate(lines):
        m = directive.match(line)
        if m:
            w = m.group(1)
            if w.startswith("if"):
                where.append([1, counts[no]])
            elif w == "endif":
                where.pop()
            else:
                where[-1][0] += 1
            continue
        if all(b == 1 for b, _ in where):
            first.append(line)
        if all(b == n for b, n in where):
            last.append(line)
    return [text, "\n".join(first), "\n".join(last)]
