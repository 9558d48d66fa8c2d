"""Problem 1: variant spellings of names.

Names are folded (letter case, accents, order of parts, remarks in brackets, second surnames, nicknames) to a form of given
and family name. Forms are blocked by the phonetic codes of their sorted tokens, and by a form with one letter left out,
all forms of a block are compared by Jaro-Winkler, with addresses as further evidence. Identities are linked
to their form, to a personal mailbox, and to a handle (local part or user name) that a single form uses; contributors are the
connected components. Mailboxes of roles and machines, and those that people of different names share, link nobody.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelens.operators.graphs import connected_components
from codelens.sources.checkpoints import cut

#: Given names and their short forms.
NICKNAMES = """
alexander alex sasha xander alec lex; alexandra sandra lexi; anastasia nastya stacy ana; anthony tony ant; andrew andy drew; benjamin ben benny; catherine cathy cate;
charles charlie chuck chas; christopher chris kit topher; christine chrissy tina; daniel dan danny; david dave davy; deborah deb debbie; dmitri dima mitya; dorothea thea dora dot dorothy;
edward ed eddie ted ned; elizabeth beth liz eliza lizzie betty bess libby; francesca cesca fran frankie; frederick fred freddy rick; gabriella gabby ella gabi; gregory greg; isabella bella izzy isa;
james jim jimmy jamie; jennifer jen jenny; jonathan jon jonny john nathan; joseph joe joey; josephine jo josie; katherine kate katie kathy kat kit; leonard len leo lenny; lukasz luke;
margaret maggie meg peggy marge greta daisy; matthew matt; maximilian max; michael mike mick mickey; mikhail misha; nicholas nick nico klaus; patricia pat patty trish; patrick paddy;
peter pete; philippa pippa pip phil; philip phil; priscilla cilla; rebecca becca becky bex; richard rick dick richie rich; robert bob rob bobby robbie bert; ronald ron; samantha sam sammy; samuel sam sammy;
stephen steve stevie; steven steve; susanne sue susie susi susan suzy; theodore theo teddy ted; thomas tom tommy; timothy tim timmy; victoria vicky tori vic; vincent vince; virginia ginny;
william bill liam will billy willy; ximena mena; muhammad mohammed mohamed mohammad muhammed mehmed; giovanni gianni gio vanni; giuseppe beppe peppe; francesco franco cesco; yusuf youssef yousef yousuf; sergei sergey serge; ekaterina katya; aleksandr sasha; ivan vanya; maria masha mia; katarzyna kasia; malgorzata gosia; jose pepe; francisco paco pancho; guillermo memo; ignacio nacho; johannes hans jan; wilhelm willi; heinrich heinz; zachary zach zack zak
"""
#: Names and mailboxes of nobody in particular.
NOBODY = set("admin administrator root unknown developer dev git nobody none null user username test tester anonymous anon default system daemon build builder jenkins ubuntu vagrant ec2-user localhost your-name yourname you me owner guest na n/a no-author noauthor - ?".split())
ROLES = set("admin administrator root unknown developer dev git nobody none user test anonymous system build builds builder ci cd bot bots noreply no-reply donotreply info team dev-team devteam devs dev-list support hello contact office ops devops jenkins you me mail webmaster postmaster security release releases deploy infra automation".split())
#: Words of organisations' names that don't tell them apart.
ORGANISATION = set("labs lab laboratories laboratory systems system sys foundation fndn fdn found works ltd limited inc incorporated corp corporation co company gmbh ag sa llc plc group software technologies technology tech solutions studio studios project team bot ci the and of".split())
MARKS = {"labs", "lab", "laboratories", "laboratory", "systems", "sys", "foundation", "fndn", "fdn", "works", "ltd", "limited", "inc", "incorporated", "corp", "corporation", "gmbh", "llc", "plc", "software", "technologies", "solutions", "studios"}
LETTERS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "’": "'", "`": "'"})


def _formal() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for group in NICKNAMES.replace("\n", " ").split(";"):
        names = group.split()
        for n in names:
            out.setdefault(n, []).append(names[0])
    return {n: [n] if n in to else to for n, to in out.items()}


FORMAL = _formal()


def fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower().translate(LETTERS))
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).split())


def phonetic(token: str) -> str:
    """Classes of consonants in order, without repeats; the first letter by its class, vowels as one."""
    classes = {**dict.fromkeys("bpfv", "1"), **dict.fromkeys("cgjkqsxz", "2"), **dict.fromkeys("dt", "3"), "l": "4", **dict.fromkeys("mn", "5"), "r": "6"}
    out = ""
    for i, c in enumerate(token):
        k = classes.get(c, "0" if i == 0 else "")
        if k and (not out or out[-1] != k):
            out += k
    return out


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, ours = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                ours.append(c)
                break
    m = len(ours)
    if not m:
        return 0.0
    theirs = [c for c, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(ours, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    while same < 4 and same < len(a) and same < len(b) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def read_email(email: str | None) -> tuple[str | None, str | None, str | None]:
    """(personal mailbox, handle, domain) of an address as written; None where there is none."""
    e = fold(email or "").strip("<>()[]\"' ")
    e = re.sub(r"\s*(?: at |\[at\]|\(at\))\s*", "@", e).replace("mailto:", "").replace(" ", "")
    local, _, domain = e.rpartition("@")
    if not local or not domain:
        return None, None, None
    machine = domain.endswith((".local", ".localdomain", ".invalid", ".lan", ".internal")) or "localhost" in domain
    relay = "noreply" in domain.replace("-", "")
    if relay:
        local = local.split("+", 1)[1] if re.match(r"\d+\+", local) else local
    local = local.split("+", 1)[0] or local
    if local in ROLES or machine:
        return None, None, None if machine else domain
    # a lost dot of the domain doesn't matter
    return None if relay else f"{local}@{domain.replace('.', '')}", local, domain


def read_author(author: str | None) -> tuple[str, list[str]]:
    """(kind, tokens): kind is person, organisation, handle or nobody."""
    raw = (author or "").strip()
    s = fold(raw)
    bot = "[bot]" in s
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]|\"|<[^>]*>", " ", s).strip()
    if not s or s in NOBODY or s.replace(" ", "") in NOBODY:
        return "nobody", []
    words = [w.strip(".,;") for w in re.split(r"[\s_]+", s)]
    parts = [x for w in words for x in (w.split("-") if bot else [w]) if x]
    if bot or any(x in MARKS for x in parts):
        return "organisation", [x for x in parts if x not in ORGANISATION] or parts
    if "," in s:
        last, _, first = s.partition(",")
        s = f"{first.strip()} {last.strip()}"
    if " " not in s.strip():
        if re.search(r"\d", s):
            return "handle", [s]
        split = [x for x in re.split(r"[._]", s) if x]
        return ("person", split) if len(split) >= 2 and raw.lower() != raw else ("handle", [s])
    tokens = [t for t in (re.sub(r"[^\w'-]", "", w) for w in re.split(r"[\s.]+", s)) if t]
    return "person", tokens


def formal(name: str, local: str) -> tuple[str, str | None]:
    """The full given name and, for a short form of several, the next one; the local part of the address decides."""
    names = sorted(FORMAL.get(name, [name]), key=lambda n: (n not in local, n[:1] != local[:1])) if local else FORMAL.get(name, [name])
    sure = len(names) < 2 or local and (names[0] in local or names[0][0] == local[0] != names[1][0])
    return names[0], None if sure else names[1]


#: Particles of surnames, which people write or leave out.
PARTICLES = {"al", "el", "de", "da", "di", "du", "del", "van", "von", "der", "den", "bin", "ibn", "la", "le", "dos", "ter"}


def base(token: str) -> str:
    """A surname without particles and without a second one."""
    parts = [p for p in token.split("-") if p]
    while len(parts) > 1 and parts[0] in PARTICLES:
        parts = parts[1:]
    return (parts or [token])[0].replace("'", "")


def given(token: str) -> str:
    """A given name without a second one behind a hyphen."""
    return token if token in FORMAL else token.split("-")[0] or token


def alpha(s: str | None) -> str:
    return re.sub(r"[^a-z]", "", s or "")


def read(author: str | None, email: str | None) -> dict:
    """What one identity says: first and last (formal, folded), initials, mailbox, handle, organisation."""
    mailbox, handle, domain = read_email(email)
    kind, tokens = read_author(author)
    out = dict(first=None, other=None, last=None, first_initial=None, last_initial=None, mailbox=mailbox, handle=None, organisation=None, domain=None, attested=False)
    if kind == "nobody":
        return {**out, "mailbox": None}
    if kind == "organisation":
        core = "".join(tokens)
        label = (domain or "").split(".")[0]
        return {**out, "mailbox": None, "organisation": core, "domain": domain if domain and jaro_winkler(core, label) >= 0.8 else None}
    full = [t for t in tokens if len(t) > 1] if kind == "person" else []
    single = [t for t in tokens if len(t) == 1] if kind == "person" else []
    local = alpha(handle)
    if len(full) >= 2:
        first, last = given(full[0]), base(full[-1])
        out["first"], out["other"] = formal(first, local)
        out["last"] = last
        out["attested"] = bool(local) and last in local and (first in local or first[0] in local)
    elif len(full) == 1 and single:
        if tokens[0] in single:
            out |= {"first_initial": single[0], "last": base(full[0])}
        else:
            out |= {"first": formal(full[0], local)[0], "last_initial": single[-1]}
    for h in ([handle] if handle else []) + ([tokens[0]] if kind == "handle" else []):
        if out["handle"] is None and not re.search(r"\d", h) and len(alpha(h)) >= 5:
            out["handle"] = alpha(h)
    if kind == "handle" and not out["last"]:
        # user.name: which part is the given name, the author or the table must tell
        pieces = [x for x in re.split(r"[._-]", handle or tokens[0]) if x.isalpha() and len(x) > 1]
        named = alpha(tokens[0])
        if len(pieces) == 2 and (named in pieces or any(x in FORMAL for x in pieces)):
            a, b = pieces if pieces[0] == named or pieces[0] in FORMAL and pieces[1] != named else pieces[::-1]
            out |= {"first": formal(a, local)[0], "last": b}
    return out


FEATURES = "id bigint, first string, other string, last string, first_initial string, last_initial string, mailbox string, handle string, organisation string, domain string, attested boolean"


def features(df: DataFrame, key: str, author: str, email: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [{"id": k, **read(a, e)} for k, a, e in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FEATURES.split(", ")])

    return df.select(F.col(key).cast("bigint"), author, email).mapInPandas(run, FEATURES)


def _left_out(column: str) -> str:
    """The value itself and each way to leave one letter out."""
    return f"array_distinct(concat(array({column}), transform(sequence(1, greatest(length({column}), 1)), i -> concat(substr({column}, 1, i - 1), substr({column}, i + 1)))))"


def inflected(x: str, y: str) -> bool:
    """Whether one is the other with a final vowel: two names (Robert, Roberta), not two spellings, if both are attested."""
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and y.startswith(x) and y[-1] in "aeio"


#: Least Jaro-Winkler similarity of the less similar of two names, by how many of both forms an address attests (none, one, both):
#: where the other name is equal, and where both differ. Each address that spells a form speaks against a misspelling.
LEAST_EQUAL, LEAST_BOTH = (0.84, 0.86, 0.92), (0.9, 0.93, 0.97)
#: Blocks of more forms are shared out among tasks; results don't depend on it.
HOT_BLOCK = 2_000


def letters(s: str) -> int:
    """A bit for each letter that occurs; letters may share one."""
    bits = 0
    for c in s:
        bits |= 1 << ord(c) % 63
    return bits


def blocks(forms: DataFrame, hot: int = HOT_BLOCK) -> DataFrame:
    """(form, first, last, attested, first_letters, last_letters, key, part, own): the keys under which forms are compared: phonetic
    codes of the sorted tokens, or one name and the other but for a letter. Keys are counted with map-side combine.

    The forms of a hot key are dealt to parts, and each two parts get a key of their own, so that every two forms still meet.
    Forms of one part meet under the part's own key; under the others only those of different parts need comparing."""

    def codes(batches):
        for b in batches:
            b["first_letters"], b["last_letters"] = [letters(f) for f in b["first"]], [letters(x) for x in b["last"]]
            b["code"] = ["|".join(sorted((phonetic(f), phonetic(x)))) for f, x in zip(b["first"], b["last"])]
            yield b

    f = forms.select("form", "first", "last", "attested").mapInPandas(codes, "form string, first string, last string, attested boolean, first_letters bigint, last_letters bigint, code string")
    keys = F.expr(f"concat(array(concat('P', code)), transform({_left_out('last')}, x -> concat('L', first, '|', x)), transform({_left_out('first')}, x -> concat('F', last, '|', x)))")
    k = cut(f.withColumn("key", F.explode(keys)).drop("code"))
    busy = k.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).alias("parts"))
    k = k.join(busy, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.expr("pmod(xxhash64(form), parts)"))
    k = k.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return k.withColumn("key", F.concat_ws("|", "key", F.least("part", "other"), F.greatest("part", "other"))).withColumn("own", F.expr("part = other")).drop("parts", "other")


def _most(x: str, y: str, in_x: str, in_y: str) -> str:
    """At least the Jaro-Winkler similarity of two columns: letters that the other lacks match none, any order will do."""
    m = f"least(length({x}) - bit_count({in_x} & ~{in_y}), length({y}) - bit_count({in_y} & ~{in_x}))"
    same = "case " + " ".join(f"when left({x}, {i}) = left({y}, {i}) then {i}" for i in (4, 3, 2, 1)) + " else 0 end"
    return f"case when {x} = {y} then 1 else 1 - (2 - {m} * (1D / greatest(length({x}), 1) + 1D / greatest(length({y}), 1))) / 3 * (1 - 0.1D * {same}) end"


def may_be_near() -> str:
    """Whether two forms may be as similar as they must; leaves out no pair that is."""
    equal, both = (f"element_at(array({', '.join(f'{x}D' for x in least)}), 1 + cast(attested as int) + cast(to_attested as int))" for least in (LEAST_EQUAL, LEAST_BOTH))
    low = f"least({_most('first', 'to_first', 'first_letters', 'to_first_letters')}, {_most('last', 'to_last', 'last_letters', 'to_last_letters')})"
    return f"{low} >= case when first = to_first or last = to_last then {equal} else {both} end - 1e-9D"


def near_forms(forms: DataFrame, others: DataFrame) -> DataFrame:
    """(form, to): forms that spell another one's name, and the least form of their cluster.

    forms: form, first, last, attested (whether an address spells it); others: form, to by another reading of a nickname.
    All forms of a block are compared by Jaro-Winkler, attested or not, whatever the block's size (pairs that lengths and letters rule
    out are dropped first); how similar they must be depends on the addresses.
    A form that no address attests is linked to the most similar attested one (of equals, the first by name); accepted pairs are
    clustered by connected components.
    """
    k = blocks(forms)
    to = k.select("key", F.col("part").alias("to_part"), F.col("form").alias("to"), *(F.col(c).alias(f"to_{c}") for c in ("first", "last", "attested", "first_letters", "last_letters")))
    pairs = k.join(to, "key").where("form < to and (own or part <> to_part)").where(may_be_near())
    pairs = pairs.select("form", "first", "last", "attested", "to", "to_first", "to_last", "to_attested").distinct()

    def compare(batches):
        similar = lru_cache(1 << 18)(jaro_winkler)
        for b in batches:
            low, high = [], []
            for f, x, g, y in zip(b["first"], b["last"], b["to_first"], b["to_last"]):
                p, q = similar(f, g), similar(x, y)
                low.append(min(p, q))
                high.append(max(p, q))
            n = b["attested"].astype(int) + b["to_attested"].astype(int)
            least = [LEAST_EQUAL[i] if h == 1 else LEAST_BOTH[i] for i, h in zip(n, high)]
            forms_ = [i == 2 and (inflected(f, g) or inflected(x, y)) for i, f, x, g, y in zip(n, b["first"], b["last"], b["to_first"], b["to_last"])]
            b = b.assign(score=[0.0 if i else s for i, s in zip(forms_, low)])
            yield b[b["score"] >= least][["form", "to", "attested", "to_attested", "score"]]

    accepted = cut(pairs.mapInPandas(compare, "form string, to string, attested boolean, to_attested boolean, score double"))
    same = accepted.where(F.col("attested") == F.col("to_attested")).select("form", "to")
    mixed = accepted.where(F.col("attested") != F.col("to_attested"))
    mixed = mixed.select(F.when(F.col("attested"), F.col("to")).otherwise(F.col("form")).alias("form"), F.when(F.col("attested"), F.col("form")).otherwise(F.col("to")).alias("to"), "score")
    other = others.join(forms.where("not attested").select("form"), "form").join(forms.where("attested").select(F.col("form").alias("to")), "to")
    mixed = mixed.unionByName(other.select("form", "to", F.lit(0.99).alias("score")))
    best = mixed.groupBy("form").agg(F.max(F.struct("score", "to")).alias("b")).select("form", F.col("b.to").alias("to"))
    c = connected_components(same.union(best), "form", "to").where("node <> component")
    return c.select(F.col("node").alias("form"), F.col("component").alias("to"))


def org_near(forms: DataFrame) -> DataFrame:
    """(form, to) of organisations' names that are a letter apart: those that a domain attests to the most similar attested one, and
    names that are nearly equal to each other."""
    k = forms.select("form", "attested", F.explode(F.expr(_left_out("form"))).alias("key"))
    pairs = k.join(k.select("key", F.col("form").alias("to"), F.col("attested").alias("to_attested")), "key").where("form <> to and not attested and (to_attested or form < to)").drop("key").distinct()

    def compare(batches):
        for b in batches:
            yield b.assign(score=[jaro_winkler(x, y) for x, y in zip(b["form"], b["to"])])

    scored = pairs.mapInPandas(compare, "form string, attested boolean, to string, to_attested boolean, score double")
    best = scored.where("to_attested").groupBy("form").agg(F.max(F.struct("score", "to")).alias("b")).select("form", F.col("b.to").alias("to"))
    return best.union(scored.where("not to_attested and score >= 0.97").select("form", "to"))


def contributors(df: DataFrame, key: str = "identity_id", author: str = "author", email: str = "email") -> DataFrame:
    """(key, contributor) of each row that stands for somebody; contributor is the least key of those linked.

    Null, empty, malformed and placeholder values say nothing; repeated rows of a key are one identity; rows linked to nobody
    else are contributors of their own. Identities are linked through nodes for forms, mailboxes, handles and organisations, so
    a contributor of very many identities costs as many edges as identities.
    """
    x = cut(features(df, key, author, email).distinct())
    named = x.where("first is not null and last is not null").withColumn("form", F.concat_ws(" ", F.array_sort(F.array("first", "last"))))
    forms = named.groupBy("form").agg(F.substring_index("form", " ", 1).alias("first"), F.substring_index("form", " ", -1).alias("last"), F.max("attested").alias("attested"))
    others = named.where("other is not null").select("form", F.concat_ws(" ", F.array_sort(F.array("other", "last"))).alias("to")).distinct()
    near = near_forms(forms, others)
    form = cut(named.select("id", "form").join(near, "form", "left").select("id", F.coalesce("to", "form").alias("form")))
    orgs = x.where("organisation is not null")
    org_forms = orgs.groupBy(F.col("organisation").alias("form")).agg(F.max(F.col("domain").isNotNull()).alias("attested"))
    y = x.join(form, "id", "left")

    def single(column: str) -> DataFrame:
        """Values that no two different names use: all forms that occur with one are alike, and initials fit them."""
        brief = F.when(F.col("form").isNull() & F.col("first_initial").isNotNull(), F.concat_ws(" ", "first_initial", "last"))
        by = y.where(F.col(column).isNotNull()).groupBy(column).agg(F.min("form").alias("a"), F.max("form").alias("b"), F.min(brief).alias("c"), F.max(brief).alias("d"))

        def fits(a, b) -> bool:
            if not isinstance(a, str) or not isinstance(b, str):
                return True
            (p, q), (r, t) = a.split(" ")[:2], b.split(" ")[:2]
            if len(r) == 1:
                return any(x[0] == r and jaro_winkler(z, t) >= 0.85 for x, z in ((p, q), (q, p))) if len(p) > 1 else p == r and jaro_winkler(q, t) >= 0.85
            return jaro_winkler(p, r) >= 0.85 and jaro_winkler(q, t) >= 0.85

        def alike(batches):
            for z in batches:
                ok = [fits(r.a, r.b) and fits(r.c, r.d) and fits(r.a, r.c) for r in z.itertuples(index=False)]
                yield z[ok][[column]]

        return by.mapInPandas(alike, f"{column} string")

    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    me = F.xxhash64(F.lit("identity"), F.col("id")).alias("src")
    edges = [
        form.select(me, node("form", "form").alias("dst")),
        x.where("mailbox is not null").join(single("mailbox"), "mailbox").select(me, node("mailbox", "mailbox").alias("dst")),
        x.where("handle is not null").join(single("handle"), "handle").select(me, node("handle", "handle").alias("dst")),
        orgs.select(me, node("organisation", "organisation").alias("dst")),
        orgs.where("domain is not null").select(me, node("domain", "domain").alias("dst")),
        org_near(org_forms).select(node("organisation", "form").alias("src"), node("organisation", "to").alias("dst")),
    ]
    # an initial and a surname that a form has; of several forms that whose given name the address spells
    one, two = F.substring_index("form", " ", 1), F.substring_index("form", " ", -1)
    brief = F.array(F.concat_ws(" ", F.substring(one, 1, 1), two), F.concat_ws(" ", F.substring(two, 1, 1), one))
    short = form.select("form").distinct().select("form", F.explode(F.array_distinct(brief)).alias("short"))
    short = short.join(short.groupBy("short").agg(F.count("*").alias("n")), "short")
    initial = x.where("first_initial is not null and last is not null").select("id", "last", "handle", F.concat_ws(" ", "first_initial", "last").alias("short")).join(short, "short")
    called = F.when(one == F.col("last"), two).otherwise(one)
    initial = initial.where((F.col("n") == 1) | F.coalesce(F.col("handle").contains(called), F.lit(False))).groupBy("id").agg(F.max(F.struct((F.col("n") == 1).alias("sure"), F.length(called).alias("length"), "form")).alias("b"))
    edges.append(initial.select(me, node("form", "b.form").alias("dst")))
    someone = x.where("coalesce(first, last, mailbox, handle, organisation) is not null").select("id", me)
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.union(e)
    parts = connected_components(all_edges.union(someone.select("src", F.col("src").alias("dst"))))
    of = cut(someone.join(parts, someone["src"] == parts["node"]).select("id", "component"))
    least = of.groupBy("component").agg(F.min("id").alias("contributor"))
    return of.join(least, "component").select(F.col("id").alias(key), "contributor")


def pairs(linked: DataFrame, key: str = "identity_id") -> DataFrame:
    """(identity_a, identity_b), a < b: all pairs of identities of one contributor."""
    a, b = linked.select("contributor", F.col(key).alias("identity_a")), linked.select("contributor", F.col(key).alias("identity_b"))
    return a.join(b, "contributor").where("identity_a < identity_b").select("identity_a", "identity_b")
