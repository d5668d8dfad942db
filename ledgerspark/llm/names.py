"""Variant spellings of names typed by people, linked by their canonical rewritings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.replay import components
from ledgerspark.shared import cut, union_all

# Short forms of given names, folded as fold() does; a form may stand for several names. A default only: read()
# takes any such table.
NICKNAMES = {
    k: v.split()
    for k, v in {
        "abigail": "abby gail", "agnes": "aggie nessa", "albert": "al bert bertie", "aleksei": "alyosha lyosha", "alexander": "alex sasha sandy xander alec lex", "alexandra": "alex sasha sandra",
        "alfred": "alf alfie fred", "amanda": "mandy", "anastasia": "stacy nastya", "andreas": "andy andi", "andrew": "andy drew", "anna": "annie anja anya nan", "anthony": "tony", "antonia": "toni",
        "antonio": "toni tonio", "arthur": "art artie", "augustin": "gus august", "barbara": "barb babs barbie", "bartholomew": "bart", "beatrice": "bea bice trixie trix", "benjamin": "ben benny",
        "bernard": "bernie", "bernhard": "bernd", "bradley": "brad", "caroline": "caro carrie", "catherine": "cathy kate katie", "charles": "charlie chuck", "charlotte": "lotte lottie charlie lotta",
        "christina": "chris tina", "christopher": "chris kit", "clifford": "cliff", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dimitrios": "dimi mitsos jim dimitri",
        "dmitri": "dima mitya", "dominic": "dom nick", "donald": "don donnie", "dorothea": "dora thea dorle", "dorothy": "dot dottie dolly", "douglas": "doug", "edward": "ed eddie ted", "eleanor": "ellie nell nora",
        "elisabeth": "betty lisa elsa liz lizzy beth eliza sisi", "elizabeth": "betty lisa elsa liz lizzy beth eliza", "emily": "em emmy", "emmanuel": "manny manu", "enrique": "quique kike", "eugene": "gene",
        "ferdinand": "ferdi", "frances": "fran frankie", "francesco": "franco", "francis": "frank", "francisco": "paco pancho", "francois": "frankie fanfan franz", "frederick": "fred freddy", "frederik": "fred freddy rik fritz",
        "gabriele": "gabi", "geoffrey": "geoff", "gerald": "gerry jerry", "gerhard": "gerd", "gertrude": "trudy gerti", "giovanni": "gianni", "giuseppe": "beppe pino", "gregory": "greg gory grisha", "guillermo": "memo",
        "gunther": "gunni", "harold": "harry hal", "heinrich": "heinz heiner", "helena": "lena leni", "henrietta": "hetty etta henni", "henry": "hank harry", "ignacio": "nacho", "isabella": "isa izzy belle bella",
        "isabelle": "isa izzy belle bella", "ivan": "vanya", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy", "jennifer": "jen jenny", "jessica": "jess jessie", "joachim": "achim jochen", "johannes": "hans hannes jan",
        "john": "jack johnny", "jonathan": "jon jonny", "jorge": "coque", "jose": "pepe", "josef": "sepp jupp", "joseph": "joe joey", "joshua": "josh", "judith": "judy", "jurgen": "jorg jogi juri", "karl": "kalle",
        "katarina": "kat katja rina kathi", "katherine": "kate kathy katie kitty", "kenneth": "ken kenny", "konstantin": "kostya", "lawrence": "larry", "leonard": "len lenny leo", "leopold": "leo poldi lee", "ludwig": "lutz wiggerl",
        "magdalena": "lena magda", "manuel": "manu manolo", "margaret": "peggy maggie meg madge", "margarete": "greta grete maggie", "martin": "marty", "mathilde": "tilda tilly matty", "matthew": "matt", "matthias": "matze",
        "maximilian": "max maxi", "michael": "mike mick", "mikhail": "misha", "nathaniel": "nat nate", "nicholas": "nick nicky", "nicole": "nikki", "nikolai": "nick niko kolya", "oliver": "ollie olli", "olivier": "oli ollie olli",
        "pamela": "pam", "patricia": "pat patty trish", "patrick": "pat paddy", "pavel": "pasha", "peter": "pete", "philip": "phil pip", "philippa": "pippa pip phil", "quentin": "quin quent tino", "rafael": "rafa",
        "raymond": "ray", "rebecca": "becky becca", "renee": "ree nene renni", "richard": "rick dick rich", "robert": "bob rob bobby", "roberto": "berto beto rob", "ronald": "ron ronnie", "samantha": "sam", "samuel": "sam sammy",
        "sebastian": "basti bastian seb", "sebastien": "seb basti bastien", "sergei": "seryozha", "soren": "sorre sos", "stephanie": "steffi steph", "stephen": "steve", "steven": "steve", "susan": "sue susie suzy",
        "svetlana": "sveta", "theodora": "dora thea teddie", "theodore": "ted teddy theo", "theresa": "terry tess resi", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli", "urszula": "ula ursa uschi",
        "valentina": "tina valya", "veronica": "ronnie vera", "victoria": "vicky tori", "vincent": "vince vinnie", "vincenzo": "enzo vince cenzo", "vladimir": "volodya vova", "walter": "walt wally", "wilhelm": "willi willy",
        "william": "will bill liam billy", "wolfgang": "wolf wolfi", "xaverius": "xaver xav veri", "yevgenia": "jenny yeva zhenya", "zacharias": "zach zak harry",
    }.items()
}
# Legal forms and fillers of organisations' names, and abbreviated fields of work.
LEGAL = frozenset("inc ltd llc gmbh ag sa bv oy ab plc corp co coop cooperative foundation found fdn association assoc ev team the company limited incorporated".split())
FIELDS = ("software", "research", "networks", "data", "systems", "labs", "solutions", "technologies", "services", "consulting", "engineering", "electronics", "communications", "international", "industries", "laboratories", "university", "institute", "department", "association")
# Mailboxes of an organisation; names and mailboxes that stand for nobody.
ROLES = frozenset("git dev info builds build team hello contact support office mail code oss opensource engineering devs".split())
NOBODY = frozenset("root user admin administrator unknown none null nobody anonymous guest test tester you noreply ci bot bots jenkins runner build-bot postmaster daemon default ubuntu localhost".split())
TITLES = frozenset("phd dr msc bsc jr sr prof ing mba esq dipl".split())
_NOBODY_NAME = regex.compile(r"^(?:your name|first ?last|(?:.*[\s-])?bot|.*\[bot\]|bot .*|ci[-_ ].*|.*[-_ ]ci|.*runner.*|github actions?|dependabot.*|renovate.*|no[-_ ]?reply.*)$")
_NOWHERE = regex.compile(r"@(?:localhost|example\.(?:com|org|net)|[^@]*\.(?:local|localdomain|internal|lan))$")
_HANDLE = regex.compile(r"^[a-z]{2,}-[a-z0-9]{2,5}$")
_LETTERS = {"ø": "o", "ß": "ss", "æ": "a", "œ": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
#: Share of log-ins among the addresses of a domain from which it is taken for open to anybody.
OPEN_SHARE = 0.03
#: Score of a rewriting above which it ties: more than half of those that it reaches are one person.
LEAST_SCORE = 0.5
#: A name written once may be a misspelling of one written so often.
OFTEN = 2


def fold(s: str) -> str:
    """Lower case without marks, double-encoded UTF-8 undone, ae/oe/ue as the umlauts they are written for."""
    if "Ã" in s or "Â" in s or "Å" in s:
        try:
            s = s.encode("cp1252").decode("utf-8")
        except UnicodeError:
            try:
                s = s.encode("latin-1").decode("utf-8")
            except UnicodeError:
                pass
    s = "".join(_LETTERS.get(c, c) for c in s.lower())
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if unicodedata.category(c) not in ("Mn", "Cf"))
    return s.replace("oe", "o").replace("ue", "u").replace("ae", "a")


def full_names(nicknames: dict[str, list[str]]) -> dict[str, list[str]]:
    """The names that each short form may stand for, folded."""
    out: dict[str, list[str]] = {}
    for name, shorts in nicknames.items():
        for s in shorts:
            out.setdefault(fold(s), []).append(fold(name))
    return out


_FULL = full_names(NICKNAMES)


@dataclass
class Reading:
    """What one signature says. name: the full name, its two words in alphabetical order; claims: rewritings that
    would be another's full name or a part of one; rest: keys that identify by themselves."""

    name: str | None = None
    mid: str | None = None
    email: str | None = None
    domain: str | None = None
    handle: str | None = None
    org: str | None = None
    role: bool = False
    short: str | None = None
    claims: list[str] = field(default_factory=list)
    nobody: bool = False


def _key(a: str, b: str) -> str:
    return "|".join(sorted((a, b)))


def _words(s: str) -> tuple[list[str], list[str]]:
    """Words of over one letter, and single letters, of a folded name; of a double name the first part counts."""
    s = regex.sub(r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ", s)
    found = [w.strip(".-'’") for w in regex.split(r"[\s,;._/]+", s)]
    found = [regex.sub(r"[^\p{L}-]", "", w) for w in found]
    found = [w.split("-")[0] or w.replace("-", "") for w in found if w.strip("-")]
    found = [w for w in found if w and w not in TITLES]
    return [w for w in found if len(w) > 1], [w for w in found if len(w) == 1]


def org_name(author: str) -> str:
    """An organisation's name without legal form, order of parts, spacing and case; abbreviated fields written out."""
    s = regex.sub(r"\b((?:\p{L}\.){2,})", lambda m: m[0].replace(".", ""), fold(author))
    out = []
    for w in regex.findall(r"[\p{L}\p{N}]+\.?", s.replace("co-op", "coop")):
        bare = w.rstrip(".")
        if bare in LEGAL:
            continue
        if w.endswith(".") and len(bare) >= 3:
            bare = next((f for f in FIELDS if f.startswith(bare)), bare)
        out.append(bare)
    return "".join(out)


def read(author: str | None, email: str | None, full: dict[str, list[str]] = _FULL) -> Reading:
    r = Reading()
    a = " ".join((author or "").split())
    e = (email or "").strip().lower()
    e = regex.sub(r"\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+", "@", e).replace("(dot)", ".").replace(" ", "")
    fa = fold(a)
    if a.lower() in NOBODY or _NOBODY_NAME.match(a.lower()):
        r.nobody = True
    local, _, domain = e.partition("@")
    if local and domain:
        local = local.split("+", 1)[0]
        domain = domain.removeprefix("mail.")
        if local in NOBODY or regex.match(r"no-?reply", local) or _NOWHERE.search("@" + domain):
            r.nobody = True
        r.email, r.domain, r.role = f"{local}@{domain}", domain, local in ROLES
    else:
        local = ""
    if r.nobody:
        return r
    if r.role:
        r.org = ".".join(r.domain.split(".")[-2:])
    if _HANDLE.match(local):
        r.handle = local
    elif _HANDLE.match(a.lower()):
        r.handle = a.lower()
    given, letters = ([], []) if r.handle == a.lower() else _words(fa)
    typed = _key(given[0], given[-1]) if len(given) > 1 else None
    mid = letters[0] if letters and typed else given[1][0] if len(given) > 2 else None
    parts, dots = _words(fold(local.replace("-", ""))) if r.handle != local and regex.search(r"[._]", local) else ([], [])
    mailed = _key(parts[0], parts[-1]) if len(parts) > 1 and min(map(len, parts)) > 2 else None
    r.name = mailed or typed
    if mailed and dots:
        mid = dots[0]
    elif mailed and not typed and len(letters) == 1 and given and given[0][0] != letters[0] and letters[0] not in (w[0] for w in parts):
        mid = letters[0]
    r.mid = mid
    if r.name:
        a1, b1 = r.name.split("|")
        other = [_key(f, y) for x, y in ((a1, b1), (b1, a1)) for f in full.get(x, ()) if f not in (a1, b1)]
        if other:
            r.short, r.name = r.name, None
            r.claims = [f"n:{n}|{mid}" if mid else f"n:{n}" for n in (r.short, *other)]
    elif len(given) == 1 and letters:
        r.claims = [f"i:{letters[0]}|{given[0]}"]
        r.mid = letters[1] if len(letters) > 1 else None
    elif local and not r.handle and not r.role and regex.fullmatch(r"[a-z]{4,}", local) and (not given or given == [fold(local)] or fold(local).endswith(given[-1])):
        f = fold(local)
        r.claims = [f"i:{f[0]}|{f[1:]}"]
    return r


_COLS = [("name", "string"), ("mid", "string"), ("email", "string"), ("domain", "string"), ("handle", "string"), ("org", "string"), ("role", "boolean"), ("short", "string"), ("claims", "array<string>"), ("nobody", "boolean"), ("base", "string")]


def readings(signatures: DataFrame, id_col: str, author_col: str, email_col: str, nicknames: dict[str, list[str]] = NICKNAMES) -> DataFrame:
    rows = signatures.select(F.col(id_col).alias("id"), F.col(author_col).alias("author"), F.col(email_col).alias("email")).filter("id IS NOT NULL")

    full = full_names(nicknames)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
        for rb in batches:
            got = [read(a, e, full) for a, e in zip(rb.column("author").to_pylist(), rb.column("email").to_pylist(), strict=True)]
            base = [org_name(a) if a else None for a in rb.column("author").to_pylist()]
            cols = [pa.array([getattr(r, c) for r in got] if c != "base" else base, types[t]) for c, t in _COLS]
            yield pa.RecordBatch.from_arrays([rb.column("id"), *cols], ["id", *[c for c, _ in _COLS]])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} {t}" for c, t in _COLS))


def _fit(known: DataFrame, on: list[str], name: str) -> DataFrame:
    """The one full name that offers each form, with its middle initial, if any is known; forms that several offer have a
    score of one half at most and fit none."""
    by = known.groupBy(*on).agg(F.min("key").alias(name), F.max("key").alias("_two"), F.max("mid").alias(f"{name}_mid"))
    return by.filter(F.col(name) == F.col("_two")).drop("_two")


def _letter_off(name: Column) -> Column:
    """What is left of a full name when one of its words has lost no letter or any one, as hashes: names with such a form in
    common are a letter changed, added, lost or swapped with its neighbour apart. Hashes, so that a very long word has as many
    forms as letters, but not their square in bytes."""
    two = F.split(name, r"\|")

    def off(w: Column, other: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.length(w)), lambda j: F.xxhash64(F.concat(F.substring(w, F.lit(1), F.greatest(j - 1, F.lit(0))), F.substring(w, j + 1, F.length(w))), other))
        return F.array_distinct(cut)

    return F.array_distinct(F.concat(off(two[0], two[1]), off(two[1], two[0])))


def ties(signatures: DataFrame, id_col: str = "sig_id", author_col: str = "author", email_col: str = "email", nicknames: dict[str, list[str]] = NICKNAMES) -> tuple[DataFrame, DataFrame]:
    """The readings of all signatures, and (a, form, score): the forms that each signature (a, its node) is tied to. The
    score of a form is its rarity: the share of its commonest bearer among the people that the rewriting reaches, 1 if it
    reaches one person. See link()."""
    read_ = cut(readings(signatures, id_col, author_col, email_col, nicknames))
    some = read_.filter("NOT nobody")
    node = F.xxhash64(F.lit("s"), "id")
    sure = F.lit(1.0).alias("score")
    # domains that people share are no organisation's; domains with handles are open to anybody
    domains = some.filter("domain IS NOT NULL").groupBy("domain").agg(
        F.sum(F.when(F.col("name").isNotNull() & ~F.col("role"), 1).otherwise(0)).alias("people"),
        F.sum(F.col("role").cast("int")).alias("roles"),
        F.avg(F.when(F.col("handle").isNotNull() & F.col("email").startswith(F.concat("handle", F.lit("@"))), 1.0).otherwise(0.0)).alias("handles"),
    )
    domains = domains.select("domain", (F.col("roles") > F.col("people")).alias("firm"), (F.col("handles") >= OPEN_SHARE).alias("open"))
    some = some.join(domains, "domain", "left")
    mids = some.filter("NOT role AND name IS NOT NULL").groupBy("name").agg((F.min("mid") != F.max("mid")).alias("many"), F.count(F.lit(1)).alias("times"))
    some = cut(some.join(mids, "name", "left"))
    people = some.filter("NOT role")
    # a name seen with different middle initials stands for one person each, and without any for none of them
    keyed = people.filter("name IS NOT NULL AND (mid IS NOT NULL OR NOT coalesce(many, false))")
    keyed = keyed.withColumn("key", F.when(F.coalesce("many", F.lit(False)), F.concat_ws("|", "name", "mid")).otherwise(F.col("name")))
    edges = [keyed.select(node.alias("a"), F.concat(F.lit("n:"), "key").alias("form"), sure)]
    # what each full name offers to others' rewritings
    two = F.split("name", r"\|")
    near_miss = F.transform(_letter_off(F.col("name")), lambda x: F.concat(F.lit("d:"), x.cast("string")))
    forms = F.array(
        F.concat(F.lit("n:"), "name"),
        F.concat(F.lit("n:"), "name", F.lit("|"), F.coalesce("mid", F.lit("?"))),
        F.concat(F.lit("i:"), F.substring(two[0], 1, 1), F.lit("|"), two[1]),
        F.concat(F.lit("i:"), F.substring(two[1], 1, 1), F.lit("|"), two[0]),
    )
    offers = keyed.groupBy("key", "name", "mid", "domain").agg(F.max("times").alias("times"))
    offered = cut(offers.select("key", "domain", "mid", F.explode(F.when(F.col("times") >= OFTEN, F.concat(forms, near_miss)).otherwise(forms)).alias("form")))
    near, far = _fit(offered.filter("domain IS NOT NULL"), ["form", "domain"], "near"), _fit(offered, ["form"], "far")
    # a short form without the middle initial, where the full name is known with one, and the other way round
    bare = F.transform("claims", lambda c: F.regexp_replace(c, r"^(n:[^|]*\|[^|]*)\|.*$", "$1"))
    wanted = F.when(F.col("name").isNull(), F.array_distinct(F.concat("claims", bare))).when(F.col("times") < OFTEN, near_miss)
    claims = people.select("id", "domain", "open", "mid", F.explode(wanted).alias("form"))
    fits = claims.join(near, ["form", "domain"], "left").join(far, "form", "left")
    anywhere = F.col("domain").isNull() | F.coalesce("open", F.lit(False))
    no_clash = [F.coalesce(F.col("mid") == F.col(f"{n}_mid"), F.lit(True)) for n in ("near", "far")]
    fits = fits.select("id", F.when(no_clash[0], F.col("near")).alias("near"), F.when(no_clash[1] & anywhere, F.col("far")).alias("far"))
    fits = fits.groupBy("id").agg(F.min("near").alias("n1"), F.max("near").alias("n2"), F.min("far").alias("f1"), F.max("far").alias("f2"))
    one = F.when(F.col("n1") == F.col("n2"), F.col("n1")).when(F.col("n1").isNull() & (F.col("f1") == F.col("f2")), F.col("f1"))
    fitted = cut(fits.select("id", one.alias("key")).filter("key IS NOT NULL"))
    edges.append(fitted.select(node.alias("a"), F.concat(F.lit("n:"), "key").alias("form"), sure))
    # short forms of the same spelling belong together, even where no full name fits
    shorts = people.filter("short IS NOT NULL")
    edges.append(shorts.join(fitted, "id", "left_anti").select(node.alias("a"), F.concat_ws("|", F.lit("w:"), "short", "mid").alias("form"), sure))
    # an address or a handle is as good as the share of its commonest name, each with its rewritings, within a letter
    held = people.select("id", "name", "short", "claims", F.explode(F.array_compact(F.array(F.concat(F.lit("e:"), "email"), F.concat(F.lit("h:"), "handle")))).alias("form"))
    full = F.when(F.col("name").isNotNull(), F.array("name")).otherwise(F.transform(F.filter("claims", lambda c: c.startswith("n:")), lambda c: F.regexp_extract(c, r"^n:([^|]*\|[^|]*)", 1)))
    known = held.filter(F.size(full) > 0).select("form", F.array_sort(full).alias("full")).groupBy("form", "full").agg(F.count(F.lit(1)).alias("n"))
    chief = known.groupBy("form").agg(F.max(F.struct("n", "full"))["full"].alias("chief"))
    alike = F.arrays_overlap(F.flatten(F.transform("full", _letter_off)), F.flatten(F.transform("chief", _letter_off)))
    scored = known.join(chief, "form").groupBy("form").agg((F.sum(F.when(alike, F.col("n")).otherwise(0)) / F.sum("n")).alias("score"))
    scored = held.select("form").distinct().join(scored, "form", "left").select("form", F.coalesce("score", F.lit(1.0)).alias("score"))
    edges.append(held.join(scored, "form").select(node.alias("a"), "form", "score"))
    firms = some.filter("role AND firm")
    edges.append(firms.select(node.alias("a"), F.concat(F.lit("o:"), "org").alias("form"), sure))
    orgs = firms.filter("base <> ''").groupBy("base").agg(F.min("org").alias("org"), (1 / F.count_distinct("org")).alias("score"))
    alone = some.filter("email IS NULL AND base <> ''").select("id", "base").join(orgs, "base")
    edges.append(alone.select(node.alias("a"), F.concat(F.lit("o:"), "org").alias("form"), "score"))
    return read_, union_all(edges)


def link(signatures: DataFrame, id_col: str = "sig_id", author_col: str = "author", email_col: str = "email", nicknames: dict[str, list[str]] = NICKNAMES) -> DataFrame:
    """(id, entity): the signatures that belong to a person or an organisation; entity is the same for all of one.
    Signatures of nobody (placeholders, machines, shared accounts) and null ids have no row. Repeated ids count once for
    each of their rows. Empty tables give none; extra columns play no part.

    Every signature is rewritten into canonical forms: marks, case, order of name parts, titles and double encoding are
    undone; addresses give names; short forms of given names, initials with a surname and log-ins give the forms
    that they may stand for; a name written once gives what is left when a letter of it is; organisations lose their
    legal form. Forms are exploded and met by equi-join, and each tie is scored by the rarity of its form, the share of one
    person among those it reaches:

    * Forms that identify by themselves, a full name, an address, a handle, an organisation's domain, tie all their
      signatures together, if their score is over LEAST_SCORE: an address under many spellings of one name has 1, one
      that people share has less. A full name seen with different middle initials stands for one person each.
    * Forms that may stand for others (short forms, initials, misspellings) tie their signature to the one full name that
      fits, of those at the same domain or else of all; if several fit, to none.

    Names and addresses join with pre-aggregated sides of one row per form; ties become entities as connected
    components of the bipartite graph of signatures and forms.
    """
    read_, scored = ties(signatures, id_col, author_col, email_col, nicknames)
    node = F.xxhash64(F.lit("s"), "id")
    tied = cut(scored.filter(F.col("score") > LEAST_SCORE).select("a", F.xxhash64(F.lit("f"), "form").alias("b")).distinct())
    roots = components(tied)
    nodes = tied.select(F.col("a").alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("entity"))
    return read_.filter("NOT nobody").select("id", node.alias("node")).join(nodes, "node").select(F.col("id").alias(id_col), "entity")


def pairs(linked: DataFrame, id_col: str = "sig_id") -> DataFrame:
    """(sig_a, sig_b) for every two ids, sig_a < sig_b, of one entity: what is asked for is quadratic in an entity's
    spellings, and nothing else is paired."""
    a = linked.select(F.col(id_col).alias("sig_a"), "entity")
    b = linked.select(F.col(id_col).alias("sig_b"), "entity")
    return a.join(b, "entity").filter("sig_a < sig_b").select("sig_a", "sig_b").distinct()


