"""Links between the spellings of the names of people and organisations.

Distinct spellings are blocked by token suffixes: every suffix above a minimum length, of the token and of its mirror
image, is a key; tokens too short for that are keys whole, and those near that length without any one letter too. A
key that too many names of the vocabulary share is refined, first with the initial of another token, then with the
first letters of one, and discarded only if it is still too common. The candidates of a spelling are compared by the ratio of the longest
common subsequence: surnames, given names (with nicknames and initials) and middle initials of people, the words
(with abbreviations, acronyms and changed order) of organisations. A spelling that fits two names of different
people equally well is linked to neither.

Defined results: null, empty and blank spellings link to nothing; equal strings are no link; a mention given twice
links once; entity types other than those asked for are left out; empty tables give no links.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_SUFFIX = 3
LONGEST_SUFFIX = 8
#: Tokens up to this length also meet by what is left of them without one letter.
SHORT = 5
#: More names than this on one key call for refining, or, after refining, for discarding.
COMMON = 40
SURNAME, GIVEN, WORD_RATIO = 0.82, 0.72, 0.74
TITLES = frozenset("mr mrs ms miss dr prof capt captain lt sgt col maj gen rev hon warden ranger mgr manager supt superintendent agent officer sir madam sr sra srta hr fr frau herr mme mlle m".split())
#: Given names and their short forms (fixed values).
NICKNAMES = """abigail abby abbie gail|alden al|alexander alex alec sandy sasha|ambrose brose|beatrice bea trixie bee|benjamin ben benny benji|clement clem|cordelia delia cordy|dorothy dolly dot dottie dora|edward ed eddie ned ted teddy
elizabeth liz lizzie beth betty bess betsy eliza libby|florence flo flossie|frederick fred freddie fritz|gilbert gil bert|harlan harl|henrietta hetty etta hattie harriet|josephine jo josie|katherine kate kitty katie kathy kay
lawrence larry laurie lars|leonard len lenny leo|margaret peg peggy maggie meg marge madge|nathaniel nat nate nathan|orrin orrie|robert bob rob bobby robbie bert|rosalind roz rosie rose|samuel sam sammy|theodore ted theo teddy|virginia ginny ginger
walter walt|william will bill billy willie|winifred winnie fred freda|james jim jimmy jamie|john jack johnny|charles charlie chuck|richard dick rick richie|thomas tom tommy|mary molly polly mamie|anne ann annie nan nancy|helen nell nellie|george georgie|henry hank harry hal|joseph joe joey|michael mike mick|daniel dan danny|david dave davy|stephen steve|andrew andy drew|anthony tony|susan sue susie|catherine cathy kate|patricia pat patsy|barbara barb babs|eleanor ellie nora nell|martha patty mattie|sarah sally sadie|matthew matt|gregory greg|philip phil|peter pete|raymond ray|ronald ron|donald don|kenneth ken|albert al bert|alfred al fred|arthur art|ernest ernie|francis frank|herbert herb bert|eugene gene|gerald gerry jerry|harold hal harry|isaac ike|jacob jake|lewis lou|vincent vince|victoria vicky|rebecca becky|priscilla cilla|louise lou|judith judy|frances fanny fran|caroline carrie|charlotte lottie|christine chris tina|emily em emmy|gertrude trudy gert|isabella bella|jane jenny|matilda tilly|millicent millie|penelope penny"""  # fmt: skip
#: Digits that scans put for letters, inside words only (fixed values).
MISREAD = str.maketrans("015", "ols")
SMALL_WORDS = frozenset(("the", "of", "and", "n", "&", "for"))


@functools.cache
def formal() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for group in re.split(r"[|\n]", NICKNAMES):
        first, *short = group.split()
        for n in (first, *short):
            out.setdefault(n, set()).add(first)
    return {n: frozenset(v) for n, v in out.items()}


def fold(text: str) -> str:
    """Lower case without accents, stray breaks and the digits that scans put for letters."""
    t = unicodedata.normalize("NFKD", re.sub(r"(?<=[a-z])U(?=[a-z])", "ll", text))
    t = "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    t = re.sub(r"(?<=\w)[-¬‐]\s+(?=\w)", "", t).replace("’", "'").replace("co-op", "coop")
    t = re.sub(r"[^\W_]*[a-z][^\W_]*", lambda m: m[0].translate(MISREAD) if sum(map(str.isdigit, m[0])) < 0.5 * len(m[0]) else m[0], re.sub(r"(?<=[a-z])[|!](?=[a-z])", "l", t))
    return t


@functools.lru_cache(200_000)
def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 2 * common(a, b) / (len(a) + len(b)) if a or b else 0.0


def likeness(a: str, b: str) -> float:
    """The better of the ratios as written and with "rn" read as "m"."""
    best = ratio(a, b)
    if best < 1 and ("rn" in a or "rn" in b):
        best = max(best, ratio(a.replace("rn", "m"), b.replace("rn", "m")))
    return best


@functools.lru_cache(200_000)
def orders(text: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The ways to read a text as (surname, given names)."""
    t = fold(text)
    before, comma, after = t.partition(",")
    words = lambda s: [w for w in re.split(r"[.\s]+", re.sub(r"[^\w.'\s-]", " ", s)) if w]
    plain = lambda s: [w for w in words(s) if w not in TITLES or len(w) == 1]
    if comma and after.strip() and not re.fullmatch(r"\s*(jr|sr|ii|iii)\.?\s*", after):
        return (("".join(plain(before)), tuple(plain(after))),)
    parts = plain(before)
    if not parts:
        return ()
    if len(parts) == 1:
        return ((parts[0], ()),)
    out = [(parts[-1], tuple(parts[:-1]))]
    if len(parts[0]) > 1:
        out.append((parts[0], tuple(parts[1:])))
    # a blank inside the surname
    if len(parts) > 2 and len(parts[-2]) > 2:
        out.append((parts[-2] + parts[-1], tuple(parts[:-2])))
    return tuple(out)


def given_score(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    if not a or not b:
        return 0.6
    x, y = a[0], b[0]
    xs, ys = formal().get(x, frozenset((x,))), formal().get(y, frozenset((y,)))
    if len(x) == 1 or len(y) == 1:
        score = 0.8 if x == y or any(n[0] == y[0] for n in xs if len(y) == 1) or any(n[0] == x[0] for n in ys if len(x) == 1) else 0.0
    elif x == y:
        score = 1.0
    elif xs & ys:
        score = 0.95
    else:
        score = max(likeness(m, n) for m in {x, *xs} for n in {y, *ys})
        score = score if score >= GIVEN else 0.0
    if score and len(a) > 1 and len(b) > 1:
        score = score if a[1][0] == b[1][0] else 0.0
    elif score and len(a) > 1 < len(a[1]) > 2:
        # a second long word that the other lacks belongs to another name
        score = 0.0
    return score


def person_score(form: str, name: str) -> float:
    best = 0.0
    for surname, given in orders(form):
        for other, names in orders(name)[:1]:
            s = likeness(surname, other)
            # a surname of two letters counts as it is written, with a given name on both sides
            sure = len(surname) > 2 if len(other) > 2 else len(other) == 2 and surname == other and given and names
            if s >= SURNAME and sure and (g := given_score(given, names)):
                best = max(best, 0.6 * s + 0.4 * g)
    return best


@functools.lru_cache(200_000)
def words_of(text: str) -> tuple[str, ...]:
    t = re.sub(r"'", "", fold(text))
    return tuple(w for w in re.split(r"[^\w&]+", t) if w)


@functools.lru_cache(200_000)
def organisation_orders(text: str) -> tuple[tuple[str, ...], ...]:
    words = words_of(text)
    plain = tuple(w for w in words if w not in SMALL_WORDS)
    if "of" in words[1:-1]:
        at = len(words) - 1 - words[::-1].index("of")
        turned = tuple(w for w in (*words[at + 1 :], *words[:at]) if w not in SMALL_WORDS)
        return (plain, turned)
    return (plain,)


def word_score(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = sorted((a, b), key=len)
    if 2 <= len(short) < len(long) and short[0] == long[0] and common(short, long) == len(short) and len(short) <= 0.75 * len(long):
        return 0.95
    r = likeness(a, b)
    return r if r >= WORD_RATIO else 0.0


@functools.lru_cache(50_000)
def acronyms(name: str) -> frozenset[str]:
    return frozenset("".join(w[0] for w in o) for o in organisation_orders(name) if len(o) > 2)


def is_acronym(form: str) -> str:
    t = form.strip()
    if re.fullmatch(r"(?:[A-Za-z]\.\s?){2,}[A-Za-z]\.?|[A-Z]{3,}", t):
        return re.sub(r"[^A-Za-z]", "", t).lower()
    return ""


def organisation_score(form: str, name: str) -> float:
    if (short := is_acronym(form)) and short in acronyms(name):
        return 0.9
    best = 0.0
    for a in organisation_orders(form):
        for b in organisation_orders(name):
            if len(a) == len(b) and len(a) > 1:
                scores = [word_score(x, y) for x, y in zip(a, b)]
                if all(scores):
                    best = max(best, sum(scores) / len(scores))
            elif abs(len(a) - len(b)) == 1 and len(a) > 2:
                # a blank too many or too few: the joined words decide
                r = ratio("".join(a), "".join(b))
                best = max(best, r if r >= 0.93 else 0.0)
    return best


SCORES = {"Person": person_score, "Organization": organisation_score}


def keys(text: str) -> set[tuple[str, str]]:
    """(suffix, ""), and for refining (suffix, initial of another token) and (suffix, first letters of another token)."""
    tokens = set(words_of(text)) - SMALL_WORDS
    expanded = [(t, t) for t in tokens] + [(f, t) for t in tokens for f in formal().get(t, ()) if f != t]
    out = set()
    for token, source in expanded:
        if len(token) < 2:
            continue
        others = [n for t in tokens if t != source for n in {t, *formal().get(t, ())}]
        rest = {"+" + n[0] for n in others} | {"++" + n[:3] for n in others if len(n) > 2} or {"+"}
        own = set()
        if len(token) <= SHORT:
            own.add("#" + token)
            if len(token) > 3:
                own.update("#" + token[:i] + token[i + 1 :] for i in range(len(token)))
        for way, mark in ((token, ""), (token[::-1], "<")):
            if len(token) > LEAST_SUFFIX:
                own.update(mark + way[-n:] for n in {*range(LEAST_SUFFIX, min(len(way), LONGEST_SUFFIX) + 1), len(way)})
        for k in own:
            out.add((k, ""))
            out.update((k, r) for r in rest)
    for a in {is_acronym(text)} - {""} or acronyms(text):
        out.add(("=" + a, ""))
    # a blank too many or too few inside a name
    if len(whole := "".join(words_of(text))) > SHORT:
        out.update({("|" + whole[:6], ""), ("|" + whole[-6:], "")})
    return out


#: Names whose keys are held at once.
CHUNK = 500


def _keyed(column: str, common=None, plain: bool = True):
    """Keys of a column's names: suffixes as such if plain, refined ones of the suffixes in ``common`` (of all if it is None)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = common.value if common is not None else None
        for b in batches:
            values = list(b[column])
            for i in range(0, len(values), CHUNK):
                rows = [(v, k, extra) for v in values[i : i + CHUNK] for k, extra in keys(v) if (plain if extra == "" else wanted is None or k in wanted)]
                yield pd.DataFrame(rows, columns=[column, "suffix", "extra"])

    return kernel


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names that a form means, of its candidates."""
    for b in batches:
        rows = []
        for form, names in zip(b["form"], b["names"]):
            scored = []
            for c in names:
                s = SCORES[c["entity_type"]](form, c["name"])
                if s:
                    scored.append((s, c["entity_type"], c["name"]))
            if not scored:
                continue
            scored.sort(key=lambda x: (-x[0], x[1], x[2]))
            best = scored[0]
            same = [x for x in scored if x[1] == best[1] and (x[2] == best[2] or SCORES[best[1]](x[2], best[2]))]
            others = [x for x in scored if x not in same]
            if others and others[0][0] > best[0] - 0.02:
                continue
            rows += [(form, t, n) for _, t, n in same]
        yield pd.DataFrame(rows, columns=["form", "entity_type", "name"])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Distinct rows of a key over all tasks, however few bytes they have: what follows multiplies them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def kept_keys(keyed: DataFrame) -> DataFrame:
    """suffix, extra, entity_type, name: the keys of the vocabulary that block. A suffix as such if at most COMMON names have
    it, else refined by an initial, and where that is too common too by first letters."""
    size = keyed.groupBy("suffix", "extra").agg(F.count("name").alias("names"))
    level = F.when(F.col("extra") == "", 0).when(F.col("extra").startswith("++"), 2).otherwise(1)
    rare = size.where(F.col("names") <= COMMON).withColumn("level", level)
    common = size.where(F.col("names") > COMMON).select("suffix", (level + 1).alias("level")).distinct().unionByName(keyed.select("suffix", F.lit(0).alias("level")).distinct())
    use = rare.join(common, ["suffix", "level"], "left_semi").select("suffix", "extra")
    return keyed.join(use, ["suffix", "extra"], "left_semi").select("suffix", "extra", "entity_type", "name")


def form_links(forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """form, entity_type, name for every spelling (column form, distinct) and each name of the vocabulary it means."""
    from fieldlore.session import cut, small_or_plain

    from fieldlore import session

    names = vocabulary.select("entity_type", "name").distinct()
    once, of_name, of_form = spread(names.select("name").distinct(), "name"), "name string, suffix string, extra string", "form string, suffix string, extra string"
    # suffixes that are common enough to be refined are few: only theirs are refined, on both sides
    bare = cut(once.mapInPandas(_keyed("name", forms.sparkSession.sparkContext.broadcast(frozenset())), of_name).join(names, "name"))
    often = bare.groupBy("suffix").agg(F.count("name").alias("n")).where(F.col("n") > COMMON).select("suffix")
    common = forms.sparkSession.sparkContext.broadcast(frozenset(r.suffix for r in often.toLocalIterator())) if often.count() <= session.BROADCAST_ROWS else None
    keyed = bare
    if common is None or common.value:
        keyed = cut(bare.unionByName(once.mapInPandas(_keyed("name", common, plain=False), of_name).join(names, "name").select(*bare.columns)))
    kept = cut(kept_keys(keyed))
    met = spread(forms, "form").mapInPandas(_keyed("form", common), of_form).join(small_or_plain(kept), ["suffix", "extra"])
    candidates = met.groupBy("form").agg(F.collect_set(F.struct("entity_type", "name")).alias("names"))
    return candidates.mapInPandas(_decide, "form string, entity_type string, name string")


def link(mentions: DataFrame, entities: DataFrame, types: tuple[str, ...] = ("Person", "Organization")) -> DataFrame:
    """key_a, key_b: mention_id and name, or two names, of one person or organisation, whose strings differ."""
    from fieldlore.session import cut, salted

    vocabulary = entities.where(F.col("entity_type").isin(*types) & F.col("name").isNotNull() & (F.trim("name") != "")).select("entity_type", "name").distinct()
    shown = mentions.where("mention_id IS NOT NULL AND surface_form IS NOT NULL AND trim(surface_form) <> ''")
    forms = shown.select(F.col("surface_form").alias("form")).union(vocabulary.select("name")).distinct()
    linked = cut(form_links(forms, vocabulary).where("form <> name").select("form", "name").distinct())
    records = shown.select("mention_id", F.col("surface_form").alias("form")).distinct()
    # one spelling may hold a large part of all mentions: beyond a broadcast its mentions are spread by their ids
    by_mention = salted(records, linked, "form").select(F.col("mention_id").alias("a"), F.col("name").alias("b"))
    by_name = linked.join(vocabulary.select(F.col("name").alias("form")).distinct(), "form", "left_semi").select(F.col("form").alias("a"), F.col("name").alias("b"))
    return by_mention.union(by_name).select(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).distinct()
