"""Generalised LL recognition with a graph-structured stack and memoised prefixes.

Any context-free grammar, ambiguous or left-recursive, is recognised from several start symbols at once: all of them (the
dialects of a language, or the roles that a bracketed part may play) share one stack graph. A stack node is a nonterminal
at a position; it is expanded once, and every caller that reaches it later takes over what it has matched already.

What a nonterminal matches from a position depends only on the tokens that the recogniser looks at. Statements and members
(the grammar's islands) recur within and across files, so each is recognised on the tokens up to the next statement end, and
if the recogniser wanted to look further, on twice as many, until it did not. The result is that of parsing the whole text at
once, whatever the sizes; known prefixes are only looked up.

Grammar text: one rule a line, `Name: alternative | alternative`; symbols are separated by spaces and may carry ? * or +.
Capitalised symbols are nonterminals, `'x'` one of the characters x, `<ROLE>` a bracketed part that can play the role, `nl` a
line end, `eof` the end of the text or of the brackets (nothing is consumed), others are keywords or token classes. An
alternative that begins with `^x` isn't tried at a token x, with `^{` at a part in braces.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left

#: What stands behind the text: its end, or, in a prefix, tokens not looked at.
END, MORE = "\0", "\x02"
NL = "\n"
#: Tokens from here on are parts in braces.
BRACE = "\U000f8000"
#: A worker forgets prefixes when they hold so many characters; only speed depends on it.
MEMORY = 8_000_000

sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))  # statements nest; interpreted calls need no machine stack


class Alternative(tuple):
    """The symbols of one alternative; alternatives are told apart by identity."""

    __hash__ = object.__hash__

    def __eq__(self, other):
        return self is other


class Grammar:
    def __init__(self, text: str, chars: dict[str, str], roles: dict[str, set[str]], islands: tuple[str, ...] = (), stops: str = ";", skip: bool = False, blocks: str = ""):
        """chars: the characters of each keyword and token class; roles: filled while parsing, read by reference; stops: a
        character class of tokens at which statements may end; skip: whether line ends may be passed over anywhere; blocks: what
        opens (group 1) and closes (group 2) blocks of words, or is a stop; only the choice of prefixes depends on it."""
        self.rules: dict[str, list[tuple]] = {}
        self.extra = 0
        self.barred: dict[Alternative, set[str]] = {}
        for line in text.strip().splitlines():
            if line.strip():
                name, _, body = line.partition(":")
                for a in re.split(r"(?<!\S)\|(?!\S)", body):
                    words = a.split()
                    alt = Alternative(self._symbols([w for w in words if w[0] != "^"], chars, roles))
                    self.rules.setdefault(name.strip(), []).append(alt)
                    if barred := {chars.get(w[1:], w[1:]) for w in words if w[0] == "^"}:
                        self.barred[alt] = barred
        missing = {s for alts in self.rules.values() for a in alts for s in a if isinstance(s, str) and s not in self.rules}
        if missing:
            raise ValueError(f"no rules for {sorted(missing)}")
        self.islands, self.skip, self.stop = frozenset(islands), skip, re.compile(f"[{stops}]")
        self.blocks = re.compile(blocks) if blocks else None
        self.memo: dict[tuple, tuple] = {}
        self.held = 0
        self._merge()
        self._chains()
        self._turn()
        self._first()

    def _merge(self) -> None:
        """Nonterminals that are single tokens only become sets of tokens where they are used: a look instead of a stack node."""
        done: set[str] = set()
        while True:
            flat = {n: frozenset().union(*(a[0] for a in alts)) for n, alts in self.rules.items() if n not in done and n not in self.islands and alts and all(len(a) == 1 and isinstance(a[0], frozenset) and not (isinstance(a, Alternative) and a in self.barred) for a in alts)}
            if not flat:
                return
            done |= flat.keys()
            for name, alts in self.rules.items():
                for i, a in enumerate(alts):
                    if any(isinstance(s, str) and s in flat for s in a):
                        new = Alternative(flat.get(s, s) if isinstance(s, str) else s for s in a)
                        if isinstance(a, Alternative) and a in self.barred:
                            self.barred[new] = self.barred.pop(a)
                        alts[i] = new

    def _chains(self) -> None:
        """Lists of statements: rules of tokens, islands and other such rules, with themselves at the end only. A loop follows them."""
        fits: set[str] = set()

        def plain(name: str, alt: tuple) -> bool:
            barred = isinstance(alt, Alternative) and alt in self.barred
            return not barred and all(not isinstance(s, str) or s in self.islands or s in fits or s == name and i == len(alt) - 1 for i, s in enumerate(alt))

        while new := {n for n, alts in self.rules.items() if n not in fits and n not in self.islands and all(plain(n, a) for a in alts)}:
            fits |= new
        parts = {n: {s for a in self.rules[n] for s in a if isinstance(s, str)} for n in fits}
        self.chains = {n for n in fits if parts[n] & self.islands}
        while new := {n for n in fits - self.chains if parts[n] & self.chains} | {s for n in self.chains for s in parts[n] & fits} - self.chains:
            self.chains |= new
        #: Of a chain that repeats one island, maybe with another one as its end: the two, and whether the chain may be empty.
        self.lists: dict[str, tuple] = {}
        for n in self.chains:
            forms = {tuple(a) for a in self.rules[n]}
            again = [a[0] for a in forms if len(a) == 2 and a[1] == n and a[0] in self.islands]
            last = [a[0] for a in forms if len(a) == 1 and a[0] in self.islands and a[0] not in again]
            if len(again) == 1 and len(last) <= 1 and forms <= {(), (again[0], n), (again[0],), (*last,)} and (() in forms or (again[0],) in forms):
                self.lists[n] = again[0], last[0] if last else None, () in forms

    def _turn(self) -> None:
        """Rules that repeat on the right, A: b A | c, become A: B c with B: | B b, which are the same strings: a long list is then
        one stack node whose matches go on, not a node for each of its tails."""
        for name in list(self.rules):
            alts = self.rules[name]
            ends = lambda a: bool(a) and isinstance(a[-1], str) and a[-1] == name
            again = [a for a in alts if ends(a)]
            inside = any(isinstance(s, str) and s == name for a in alts for s in (a[:-1] if ends(a) else a))
            if not again or inside or name in self.islands or name in self.chains or any(a in self.barred for a in alts if isinstance(a, Alternative)):
                continue
            self.extra += 1
            front = f"_{self.extra}"
            self.rules[front] = [(), *[(front, *a[:-1]) for a in again]]
            self.rules[name] = [(front, *a) for a in alts if not ends(a)]

    def _symbols(self, words: list[str], chars, roles) -> tuple:
        out = []
        for w in words:
            suffix = w[-1] if len(w) > 1 and w[-1] in "?*+" and not w.endswith("'") else ""
            w = w[: -1] if suffix else w
            if w[0] == "'":
                sym = frozenset(w[1:-1])
            elif w[0] == "<":
                sym = roles.setdefault(w[1:-1], set())
            elif w in ("nl", "eof"):
                sym = frozenset(NL if w == "nl" else END)
            else:
                sym = frozenset(chars[w]) if w in chars else w
            if suffix:
                self.extra += 1
                name = f"_{self.extra}"
                self.rules[name] = [(), (name, sym)] if suffix == "*" else [(), (sym,)] if suffix == "?" else [(sym,), (name, sym)]
                sym = name
            out.append(sym)
        return tuple(out)

    def _first(self) -> None:
        """Which rules match nothing, and the terminals that an alternative can begin with and that may follow a rule (kept as sets by reference)."""
        self.empty: set[str] = set()
        grown = True
        while grown:
            grown = False
            for n, alts in self.rules.items():
                if n not in self.empty and any(all(isinstance(s, str) and s in self.empty for s in a) for a in alts):
                    self.empty.add(n)
                    grown = True
        self.lists = {n: v for n, v in self.lists.items() if v[2] or v[0] not in self.empty}
        # sets as bits
        sets = [*{self._key(s): s for alts in self.rules.values() for a in alts for s in a if not isinstance(s, str)}.items()]
        bit = {key: 1 << i for i, (key, _) in enumerate(sets)}
        begin = dict.fromkeys(self.rules, 0)

        def begins(alt: tuple) -> int:
            out = 0
            for s in alt:
                if not isinstance(s, str):
                    return out | bit[self._key(s)]
                out |= begin[s]
                if s not in self.empty:
                    break
            return out

        def closure(table: dict[str, int], parts: list[tuple[str, int, list[str]]]) -> None:
            """Each part: what its rule has at least, and the rules whose bits it takes over."""
            grown = True
            while grown:
                grown = False
                for n, own, others in parts:
                    new = table[n] | own
                    for o in others:
                        new |= table[o]
                    if new != table[n]:
                        table[n] = new
                        grown = True

        fronts, tails = [], []
        for n, alts in self.rules.items():
            for a in alts:
                own, others = 0, []
                for s in a:
                    if not isinstance(s, str):
                        own = bit[self._key(s)]
                        break
                    others.append(s)
                    if s not in self.empty:
                        break
                fronts.append((n, own, others))
        closure(begin, fronts)
        for n, alts in self.rules.items():
            for a in alts:
                behind, blank = 0, True  # what the symbols behind begin with, and whether they may be empty
                for s in reversed(a):
                    if isinstance(s, str):
                        tails.append((s, behind, [n] if blank else []))
                        behind = begin[s] | (behind if s in self.empty else 0)
                        blank = blank and s in self.empty
                    else:
                        behind, blank = bit[self._key(s)], False
        after = dict.fromkeys(self.rules, 0)
        closure(after, tails)
        lists: dict[int, list] = {}

        def listed(mask: int) -> list:
            if mask not in lists:
                lists[mask] = [s for i, (_, s) in enumerate(sets) if mask >> i & 1]
            return lists[mask]

        self.alts = {n: [(a if isinstance(a, Alternative) else Alternative(a), listed(begins(a)), all(isinstance(s, str) and s in self.empty for s in a)) for a in alts] for n, alts in self.rules.items()}
        self.after = {n: listed(mask) for n, mask in after.items()}
        self.choice: dict[tuple[str, str], list] = {}
        self.follow: dict[tuple[str, str], bool] = {}

    @staticmethod
    def _key(s) -> object:
        """Sets of tokens are told apart by what they hold, roles, which are filled later, by identity."""
        return s if isinstance(s, frozenset) else id(s)

    def choices(self, name: str, c: str) -> list:
        """The alternatives of a nonterminal that can begin with the token. A token's roles never change, so choices are kept."""
        got = self.choice.get((name, c))
        if got is None:
            got = [a for a, begins, empty in self.alts[name] if empty and self.followed(name, c) or any(c in b for b in begins)]
            if self.barred:
                got = [a for a in got if not (b := self.barred.get(a)) or c not in b and not ("{" in b and c >= BRACE)]
            self.choice[name, c] = got
        return got

    def followed(self, name: str, c: str) -> bool:
        """Whether the token may stand behind the nonterminal anywhere; where it may not, no match that ends there is of use."""
        got = self.follow.get((name, c))
        if got is None:
            got = self.follow[name, c] = c in (END, MORE) or self.skip and c == NL or any(c in s for s in self.after[name])
        return got

    def matches(self, starts: tuple[str, ...], text: str) -> set[str]:
        """Those of the start symbols that derive the whole text."""
        ends, _ = self._run(starts, text, True)
        return {s for s, e in zip(starts, ends) if len(text) in e}

    def _outline(self, text: str) -> tuple[list[int], list[int]]:
        """(positions, ends): a statement that begins behind one position, at the next one at the latest, probably reaches to the
        end that belongs to the next: the first stop outside of the blocks opened since, or the word that closes the block around."""
        events, depth = [], 0
        for m in self.blocks.finditer(text):
            events.append((m.start(), m.end(), depth, m.lastindex))
            depth += (m.lastindex == 1) - (m.lastindex == 2)
        nearest: dict[int, int] = {}
        ends = []
        for _, end, depth, kind in reversed(events):
            if kind != 1:
                nearest[depth] = end
            ends.append(nearest.get(depth, len(text)))
        return [e[0] for e in events], ends[::-1]

    def _prefixes(self, name: str, text: str, pos: int, n: int, final: bool, outline: tuple | None, base: int) -> tuple:
        """(lengths that the nonterminal matches from pos, whether tokens behind n matter): by ever longer prefixes."""
        at, count, next_ = pos, 1, False
        while True:
            if next_:  # the token behind the first statement end may be all that it takes
                end = min(at + 1, n)
            elif outline:
                for _ in range(count):
                    k = bisect_left(outline[0], at + base)
                    at = min(outline[1][k] - base, n) if k < len(outline[1]) else n
                    if at == n:
                        break
                end = at
            else:
                for _ in range(count):
                    m = self.stop.search(text, at, n)
                    if m is None:
                        at = n
                        break
                    at = m.end()
                end = at
            last = end == n
            key = (name, text[pos:end], final and last)
            got = self.memo.get(key)
            if got is None:
                (ends,), more = self._run((name,), key[1], key[2], outline, base + pos)
                got = tuple(ends), more
                self.held += end - pos
                if self.held > MEMORY:
                    self.memo.clear()
                    self.held = 0
                self.memo[key] = got
            if last or not got[1]:
                return got
            next_ = count == 1 and not next_
            if not next_:
                count *= 2

    def _walk(self, name: str, text: str, pos: int, n: int, final: bool, outline: tuple | None, base: int, out: set[int]) -> bool:
        """Adds the ends of a chain that begins at pos; returns whether tokens behind n matter."""
        more, skip, known = False, self.skip, {}
        todo, seen = [pos], {pos}
        if name in self.lists:
            island, last, empty = self.lists[name]
            choice, memo, search, outlined = self.choice, self.memo, self.stop.search, outline is not None
            while todo:
                at = todo.pop()
                c = text[at]
                if (empty or at != pos) and self.followed(name, c):
                    out.add(at)
                if last and (c == MORE or skip and c == NL or choice.get((last, c)) or self.choices(last, c)):
                    got = self._prefixes(last, text, at, n, final, outline, base)
                    more = more or got[1]
                    out.update(at + e for e in got[0] if self.followed(name, text[at + e]))
                if c != MORE and not (skip and c == NL) and not (choice.get((island, c)) or self.choices(island, c)):
                    continue
                m = None if outlined else search(text, at, n)
                got = m and memo.get((island, text[at : m.end()], final and m.end() == n))
                if not got or got[1] and m.end() < n:
                    got = self._prefixes(island, text, at, n, final, outline, base)
                more = more or got[1]
                for e in got[0]:
                    if at + e not in seen:
                        seen.add(at + e)
                        todo.append(at + e)
            return more
        while todo:
            at = todo.pop()
            c = text[at]
            alts = self.choice.get((name, c)) or self.choices(name, c)
            if skip and c == NL:
                c = text[at + 1]
                alts = [*alts, *(a for a in self.choices(name, c) if a not in alts)]
            if c == MORE:
                more = True
            for alt in alts:
                ends = [at]
                for s in alt:
                    if s == name:
                        for p in ends:
                            if p not in seen:
                                seen.add(p)
                                todo.append(p)
                        break
                    new = []
                    for p in ends:
                        c = text[p]
                        if isinstance(s, str):
                            if c != MORE and not (skip and c == NL) and not (self.choice.get((s, c)) or self.choices(s, c)):
                                continue
                            got = known.get((s, p))
                            if got is None:
                                if s in self.chains:
                                    got = set()
                                    open_ = self._walk(s, text, p, n, final, outline, base, got)
                                else:
                                    lengths, open_ = self._prefixes(s, text, p, n, final, outline, base)
                                    got = [p + e for e in lengths]
                                known[s, p] = got
                                more = more or open_
                            new.extend(got)
                            continue
                        if c not in s and skip and c == NL:
                            p, c = p + 1, text[p + 1]
                        if c in s:
                            new.append(p + (c != END))
                        elif c == MORE:
                            more = True
                    ends = new
                    if not ends:
                        break
                else:
                    out.update(p for p in ends if self.followed(name, text[p]))
        return more

    def _run(self, starts: tuple[str, ...], text: str, final: bool, outline: tuple | None = None, base: int = 0) -> tuple[list, bool]:
        """(the ends of what each start symbol matches from the beginning, whether tokens behind the text matter). outline: of a
        text that has this one at base."""
        if self.blocks and outline is None:
            outline = self._outline(text)
        n, todo, seen, graph, more = len(text), [], set(), {}, False
        text += END if final else MORE
        islands, choices, skip, follow = self.islands, self.choice, self.skip, self.follow
        chains = self.chains if islands else ()

        def resume(back, pos: int) -> None:
            alt, dot, at = back
            c = text[pos]
            if c != MORE and not (skip and c == NL):
                if dot == len(alt):
                    if not follow.get((at[0], c), True):
                        return
                elif isinstance(s := alt[dot], str):
                    if not choices.get((s, c), True):
                        return
                elif c not in s:
                    return
            key = (*back, pos)
            if key not in seen:
                seen.add(key)
                todo.append((alt, dot, pos, graph[at]))

        def call(name: str, pos: int, back) -> bool:
            node = graph.get((name, pos))
            if node is not None:
                if back is not None and back not in node[0]:
                    node[0].add(back)
                    for end in list(node[1]):
                        resume(back, end)
                return False
            node = graph[name, pos] = ({back} if back else set(), set(), (name, pos))
            if name in chains:
                open_ = self._walk(name, text, pos, n, final, outline, base, node[1])
                if back is not None:
                    for end in list(node[1]):
                        resume(back, end)
                return open_
            if back is not None and name in islands:
                ends, open_ = self._prefixes(name, text, pos, n, final, outline, base)
                for end in ends:
                    if not self.followed(name, text[pos + end]):
                        continue
                    node[1].add(pos + end)
                    resume(back, pos + end)
                return open_
            c = text[pos]
            alts = choices.get((name, c)) or self.choices(name, c)
            for alt in alts:
                todo.append((alt, 0, pos, node))
            if skip and c == NL:
                c = text[pos + 1]
                for alt in choices.get((name, c)) or self.choices(name, c):
                    if alt not in alts:
                        todo.append((alt, 0, pos, node))
            return c == MORE

        for s in starts:
            if call(s, 0, None):
                more = True
        while todo:
            alt, dot, pos, node = todo.pop()
            size = len(alt)
            while dot < size:
                s = alt[dot]
                if isinstance(s, str):
                    c = text[pos]
                    if not choices.get((s, c), True) and c != MORE and not (skip and c == NL):
                        break  # nothing of it begins with this token
                    if call(s, pos, (alt, dot + 1, node[2])):
                        more = True
                    break
                c = text[pos]
                if c in s:
                    if pos < n:
                        pos += 1
                    dot += 1
                    continue
                if skip and c == NL:
                    c = text[pos + 1]
                    if c in s:
                        pos += 1 + (c != END)
                        dot += 1
                        continue
                if c == MORE:
                    more = True
                break
            else:
                if pos not in node[1] and (follow.get((key := (node[2][0], text[pos]))) or self.followed(*key)):
                    node[1].add(pos)
                    for back in list(node[0]):
                        resume(back, pos)
        return [graph[s, 0][1] for s in starts], more and not final
