"""Syntax check of one file by generalised LL.

The token stream is a string of token classes. Brackets always balance, so a bracketed part is parsed by itself, with every
start symbol that its kind of bracket may hold (its roles), and stands in the text around it as one token that carries the
roles it can play; indented blocks of Python are brackets too. This leaves the language unchanged and lets workers keep what
they have parsed: contents recur within and across files. Contents are parsed whole, whatever their size.

Literals with holes (formatted strings, templates, command substitutions) are tokens; the code in their holes is parsed by
the same grammar. Elements of markup in JavaScript and TypeScript become arrays of the expressions in them.
"""

from __future__ import annotations

import re
from functools import lru_cache

from codelens.llm.parsing import holes
from codelens.llm.parsing.gll import Grammar
from codelens.llm.parsing.languages import ALIASES, BRACES, LANGUAGES

BAD = "\x01"
#: A worker forgets tokens and parses when it knows so many; only speed depends on it.
CACHE = 300_000
CLASSES = {c: c for c in "nsbapkrcdvqwxlohtg"}
#: A declared encoding of a Python file, in one of its first two lines.
CODING = re.compile(rb"(?:[ \t\f]*(?:#[^\n]*)?\n)?[ \t\f]*#[^\n]*?coding[:=][ \t]*([-\w.]+)")
FIRST_INDENT, INDENTS = 0x20000, 0x10000


def language_of(path: str | None, language: str | None) -> str | None:
    """The canonical language: by the column if it names a supported one, else by the extension."""
    if language and (found := ALIASES.get(language.strip().lower())):
        return found
    name = (path or "").rsplit("/", 1)[-1]
    return ALIASES.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


class Kinds(dict):
    """Token -> its class."""

    def __init__(self, owner: Language, keywords: dict[str, str], operators: dict[str, str]):
        super().__init__()
        self.owner, self.language, self.keywords, self.operators = owner, owner.name, keywords, operators

    def __missing__(self, token: str) -> str:
        kind = self._kind(token)
        if len(token) <= 40:
            if len(self) > CACHE:
                self.clear()
            self[token] = kind
        return kind

    def _kind(self, t: str) -> str:
        if not t:
            return ""
        if t in self.keywords:
            return self.keywords[t]
        if t in self.operators:
            return self.operators[t]
        c, lang = t[0], self.language
        if c == "\n":
            return self.owner.indent(t) if lang == "python" else "\n"
        if t == "\\\n":
            return ""
        if t.startswith(("//", "/*")) and len(t) > 1 and lang not in ("python", "ruby", "bash"):
            if lang in ("javascript", "typescript") or len(t) < 3 or t[1] in "/*":
                return "\n" if "\n" in t and lang in ("javascript", "typescript", "go") else ""
        if c == "#" or t.lstrip()[:1] == "#":
            if lang in ("python", "ruby", "bash"):
                return ""
            if len(t) > 1 and lang in ("c", "csharp", "javascript", "typescript"):
                return ""
        if lang == "ruby" and t.startswith(("=begin", "__END__")):
            return ""
        if lang == "bash":
            return self._bash(t)
        if lang == "ruby":
            if t == holes.HEREDOC:
                return "s"
            s = t.strip()
            if c == ":" and len(t) > 1 and t != "::" or c == "?" and len(t) > 1:
                return "s"
            if c == "%" and len(t) > 2 or s[:1] == "/" and len(s) > 1:
                return "s" if self.owner.holes_valid(t) else BAD
            if c in "@$" and len(t) > 1:
                return "i"
        if lang == "rust" and c == "'" and not t.endswith("'"):
            return "l"
        if len(t) > 1 and t[-1] in "\"'`" or t[-1] == "#" and '"' in t or t.endswith('"u8'):
            return "s" if self.owner.holes_valid(t) else BAD
        if lang in ("javascript", "typescript") and t.lstrip()[:1] == "/" and len(t.strip()) > 1:
            return "s"
        if c.isdigit() or c == "." and len(t) > 1 and t[1].isdigit():
            return "n"
        if c == "_" or c.isalpha() or c == "@" and len(t) > 1 or c == "$" and lang in ("javascript", "typescript", "c", "java"):
            return "i"
        return c if len(t) == 1 and c in ("+-*/%&|^~!<>=?:;,.(){}[]@#$" if lang == "rust" else "+-*/%&|^~!<>=?:;,.(){}[]@#") else BAD

    def _bash(self, t: str) -> str:
        c = t[0]
        if t == holes.HEREDOC:
            return "g"
        if t.lstrip()[:2] in ("<(", ">("):
            return "i" if self.owner.holes_valid(t) else BAD
        if re.fullmatch(r"(?:\{\w+\}|\d*)[<>&|]+", t) and t not in ("&", "|", "||", "&&"):
            return "h"
        if c in "()" and len(t) == 1 or c in ";&" and len(t) == 1:
            return c
        if t.startswith("(("):
            return "d"
        if t.startswith("[[") and t.endswith("]]") and len(t) > 4:
            return "d" if self.owner.holes_valid(t) else BAD
        if c in "\"'`" and len(t) == 1:
            return BAD
        if "$(" in t or "`" in t:
            return ("s" if "=(" in t and t.endswith(")") else "i") if self.owner.holes_valid(t) else BAD
        return "s" if "=(" in t and t.endswith(")") else "i"


class Language:
    def __init__(self, name: str):
        spec = LANGUAGES[name]
        self.name, self.spec = name, spec
        words = [*spec["keywords"], *spec["contextual"]]
        keywords = {k: chr(0xF0000 + i) for i, k in enumerate(words)}
        self.keywords = keywords
        names = "iC" + "".join(keywords[w] for w in spec["contextual"])
        self.roles: dict[str, set[str]] = {}
        self.grammar = Grammar(spec["grammar"], CLASSES | keywords | {"i": names, "ctor": "C"}, self.roles, spec["islands"], spec["stops"], spec.get("skip", False), re.sub(r"@(\w+)", lambda m: keywords[m.group(1)], spec.get("blocks", "")))
        self.kinds = Kinds(self, keywords, spec["operators"])
        operators = "|".join(sorted((re.escape(o) for o in spec["operators"] if len(o) > 1), key=len, reverse=True)) or chr(1)
        # the commonest tokens, with which no other begins, are tried first
        common = rf"{spec['names']}|[()\[\]{{}};,]|" if "names" in spec else ""
        self.many = re.compile(rf"(?:{common}{spec['lexer']}|{operators}|\S)", re.M)
        #: The same behind blanks, where no token begins with them; at the end of the text an empty token.
        self.all = re.compile(rf"{spec['blanks']}*+({common}{spec['lexer']}|{operators}|\S|\Z)", re.M) if "blanks" in spec else self.many
        self.declares = re.compile(spec["declares"]) if "declares" in spec else None
        self.groups: dict[str, str] = {}
        self.tokens: dict[tuple, str] = {}
        self.fragments: dict[str, bool] = {}
        self.indents: dict[tuple[int, int], str] = {}
        self.inner = re.compile(r"\([^(){}\[\]]*\)|\[[^(){}\[\]]*\]|\{[^(){}\[\]]*\}")
        self.lists = re.compile(r"(?:[ns],){2,}")
        k = keywords
        ends = f"insCp)\\]\U000f1000-\U000fffff{names}"
        if name == "go":
            self.ends = re.compile(f"(?<=[{ends}{''.join(k[w] for w in ('break', 'continue', 'fallthrough', 'return'))}])\n")
        if name in ("javascript", "typescript"):
            never = ";,=%&|^:.bakqv+/~-" + ("" if name == "typescript" else "?!>")
            self.drop = re.compile(rf"(?<=[{re.escape(never)}])\n+|\n+(?=[;,=%&|^?:.bakq)>\n])|^\n+")
        if name == "ruby":
            self.drop = re.compile(rf"(?<=[,=+*/%&|.?:bakovxr!<>-])\n+|(?<=[{k['and']}{k['or']}{k['not']}])\n+|\n+(?=\.[^.]|q)")

    # tokens

    def lex(self, text: str) -> str:
        if self.name in ("ruby", "bash"):
            tokens = [m.group() for m in self.many.finditer(text)]
            if "<<" in text:
                tokens = holes.heredocs(self, tokens)
        else:
            tokens = self.all.findall(text)
        if self.declares and (names := set(self.declares.findall(text))):
            kinds = self.kinds
            return "".join(["C" if t in names else kinds[t] for t in tokens])
        return "".join(map(self.kinds.__getitem__, tokens))

    def indent(self, token: str) -> str:
        """The class of a line end of Python: one for each width of the next line's indent, with tabs to 8 and to 1."""
        tail = token[token.rfind("\n") + 1 :]
        tail = tail[tail.rfind("\f") + 1 :]
        key = (len(tail.expandtabs(8)), len(tail))
        got = self.indents.get(key)
        if got is None:
            if len(self.indents) >= INDENTS:
                raise ValueError("too many different indents")
            got = self.indents[key] = chr(FIRST_INDENT + len(self.indents))
        return got

    def holes_valid(self, token: str) -> bool:
        found = holes.code_in(self, token)
        return found is not None and all(map(self.fragment, found))

    def fragment(self, text: str) -> bool:
        """Whether the code in a hole of a literal is what the language allows there."""
        got = self.fragments.get(text)
        if got is None:
            if len(self.fragments) > CACHE:
                self.fragments.clear()
            got = self.fragments[text] = self._fragment(text)
        return got

    def _fragment(self, text: str) -> bool:
        if self.name == "bash":
            return self._bash(text)
        codes = self.collapse(self.lex(text))
        if self.name == "python":
            codes = re.sub("[\U00020000-\U0002ffff]", "", codes)
        if BAD in codes or re.search(r"[()\[\]{}]", codes):
            return False
        if self.name == "ruby":
            return bool(self.grammar.matches(("Stmts",), self.newlines(codes, "{")))
        return bool(self.grammar.matches(({"python": "Field", "csharp": "E"}.get(self.name, "Seq"),), codes.replace("\n", "")))

    # brackets

    def group(self, m) -> str:
        return self.part(m.group())

    def part(self, text: str) -> str:
        got = self.groups.get(text)
        if got is None:
            if len(self.groups) > CACHE:
                self.groups.clear()
            got = self.groups[text] = self.token(text[0], frozenset(self.roles_of(text[0], text[1:-1])))
        return got

    def token(self, bracket: str, roles: frozenset) -> str:
        if not roles:
            return BAD
        got = self.tokens.get((bracket, roles))
        if got is None:
            got = self.tokens[bracket, roles] = chr((0xF8000 if bracket in "{\n" else 0xF1000) + len(self.tokens))
            for r in roles:
                self.roles.setdefault(r, set()).add(got)
        return got

    def roles_of(self, bracket: str, text: str) -> set[str]:
        """The roles that the contents can play: their start symbols are followed together. A run of literals and commas stands
        for its last ones: wherever a bracket holds two of them in a list, it may hold any number."""
        if BAD in text:
            return set()
        want = self.spec.get(bracket, {})
        out = {r for r, w in want.items() if w == "Tree"}  # any balanced tokens
        want = {r: w for r, w in want.items() if w != "Tree"}
        text = self.lists.sub(lambda m: m.group()[-2:], text)
        if self.name == "python" and bracket != "\n":
            text = re.sub("[\U00020000-\U0002ffff]", "", text)
        elif "\n" in text and bracket != "\n":
            if self.name == "ruby" and bracket == "(":
                plain = text.replace("\n", "")
                got = self.grammar.matches(("Stmts",), self.newlines(text, bracket)) | self.grammar.matches(tuple(sorted({*want.values()} - {"Stmts"})), plain)
                return {r for r, w in want.items() if w in got}
            text = self.newlines(text, bracket)
        got = self.grammar.matches(tuple(sorted(set(want.values()))), text)
        return out | {r for r, w in want.items() if w in got}

    def newlines(self, text: str, bracket: str) -> str:
        """Line ends as the grammar sees them: those that can't end a statement are left out."""
        if self.name == "go":
            return self.ends.sub(";", text).replace("\n", "")
        if self.name in ("javascript", "typescript"):
            return self.drop.sub("", re.sub("\n+", "\n", text)).strip("\n") if bracket == "{" else text.replace("\n", "")
        if self.name == "ruby":
            text = self.drop.sub("", re.sub("\n+", "\n", text))
            return text if bracket in "{(" else text.replace("\n", "")
        return text.replace("\n", "")

    def collapse(self, codes: str) -> str:
        last = None
        while last != codes and BAD not in codes:
            last = codes
            codes = self.inner.sub(self.group, codes)
        return codes

    # files

    def valid(self, text: str) -> bool:
        text = text.replace("\r\n", "\n").removeprefix("\ufeff")
        if not text.strip():
            return True
        if "\0" in text:
            return False
        if self.spec.get("nested_comments"):
            text = without_nested_comments(text)
        if self.name in ("c", "csharp") and re.search(r"^[ \t]*#[ \t]*(?:if|el|endif)", text, re.M):
            branches = holes.branches(text)
            return branches is not None and any(map(self._valid, branches))
        return self._valid(text) or any(map(self._valid, holes.rewritten(self, text)))

    def _valid(self, text: str) -> bool:
        if self.name == "bash":
            return self._bash(text)
        codes = self.collapse(self.lex("\n" + text if self.name == "python" else text))
        if BAD in codes or re.search(r"[()\[\]{}]", codes):
            return False
        codes = self.blocks(codes) if self.name == "python" else self.newlines(codes, "{")
        return BAD not in codes and bool(self.grammar.matches(self.spec["starts"], codes))

    def _bash(self, text: str) -> bool:
        codes = self.lex(text)
        return BAD not in codes and bool(self.grammar.matches(self.spec["starts"], re.sub("\n+", "\n", codes)))

    def blocks(self, codes: str) -> str:
        """Python's lines with indented blocks as bracketed parts; BAD where an indent returns to none of those open."""
        parts = re.split("([\U00020000-\U0002ffff])", codes)
        width = {c: k for k, c in self.indents.items()}
        stack: list[tuple[tuple[int, int], list[str]]] = [((0, 0), [])]

        def close() -> None:
            _, lines = stack.pop()
            stack[-1][1].append(self.part("\n" + "".join(lines) + "\n"))

        for mark, line in zip(parts[1::2], parts[2::2]):
            if not line:
                continue
            at, top = width[mark], stack[-1][0]
            if at[0] > top[0]:
                if at[1] <= top[1]:
                    return BAD
                stack.append((at, []))
            else:
                while at[0] < stack[-1][0][0]:
                    close()
                if at != stack[-1][0]:
                    return BAD
            stack[-1][1].append(line + "\n")
        while len(stack) > 1:
            close()
        return "".join(stack[0][1])


def without_nested_comments(text: str) -> str:
    """Block comments, which may contain each other and strings do not, become blanks."""
    if "/*" not in text:
        return text
    out, depth, at = [], 0, 0
    plain = re.compile(r"""//[^\n]*|/\*|[bc]?r(#*)"[\s\S]*?"\1|"(?:[^"\\]|\\[\s\S])*"|'(?:[^'\\\n]|\\[^\n]+?)'""")
    inside = re.compile(r"/\*|\*/")
    while m := plain.search(text, at):
        if m.group() != "/*":
            out.append(text[at : m.end()])
            at = m.end()
            continue
        out.append(text[at : m.start()])
        depth, at = 1, m.end()
        while depth:
            e = inside.search(text, at)
            if not e:
                return "".join(out) + BAD
            depth += 1 if e.group() == "/*" else -1
            at = e.end()
        out.append(" ")
    return "".join(out) + text[at:]


@lru_cache(None)
def checker(name: str) -> Language:
    return Language(name)


def valid(content: bytes | None, path: str | None, language: str | None) -> bool | None:
    """Whether some supported dialect of the file's language derives it; None if the language isn't supported."""
    name = language_of(path, language)
    if name is None:
        return None
    if not content:
        return True
    if name == "python" and (declared := CODING.match(content)):
        try:
            return checker(name).valid(content.decode(declared.group(1).decode("ascii")))
        except (UnicodeDecodeError, LookupError):
            return False
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        if name in ("python", "go", "rust", "java"):
            return False
        text = content.decode("latin-1")
    return checker(name).valid(text)
