"""Variant spellings of persons and organisations: merge-and-rematch resolution.

Every mention starts as a profile of its own. A profile unites all spellings of its mentions (surnames, given names,
initials), their organisations and identifiers, and has a blocking key for every combination of them. The profiles of
a block that can only mean one entity are merged; a merged profile is richer, gets the keys of its new combinations
and enters blocking again, until a round merges nothing. There is no limit of rounds: each merge makes profiles fewer.

Rounds are incremental. A profile whose members did not change keeps its keys, and only blocks that a changed profile
touches are judged again. Keys are pairs (hash, profile); the many keys for slips of the pen are made only of letters
left out that two different words of the vocabulary share. All attributes that blocks are judged by are numbers. Keys are
shuffled once, ordered by Spark and read as a stream by Python workers, which judge whole blocks as arrays and hold only
the block under way, some 64 bytes a profile; a block's profiles are merged as a star around its smallest, so no pairs are
made within it, however large. Only the result, whose form is pairs, lists them.

A block names one entity if it holds at most one ORCID, one given name that all initials fit, and one first middle
initial; each profile counts with its commonest form. A block with several middle initials is split by them, and the
profiles without one, which fit several parts, are left out. A profile whose blocks hold different ORCIDs fits several
people and stays where it is; so do merges that would chain two ORCIDs. Keys, from strong to weak: ORCID; author id;
the same work and place in its author list; name and organisation, also with one slip in either name; and when these
merge nothing more, name and a neighbour in the author list, and the name alone where at most one of its profiles
has an organisation or ORCID. Once the weak keys have been tried, changed profiles are matched by weak and strong ones.

Defined results: null and placeholder names ("et al.", "Anonymous") are in no pair; a null affiliation says nothing;
an organisation without a proper name is nobody; repeated rows with different ids are pairs; people with equal names
and different organisations stay apart unless an identifier, work or co-author joins them; a middle initial other than
the first tells nobody apart; words of more than 64 letters tolerate a slip in one of their halves only; empty tables
give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litsieve.functions.ids import arxiv_key, doi_key
from litsieve.llm.crossmatch import near
from litsieve.session import join_checked, materialize, release, tidy

TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "mx", "phd", "md", "msc", "bsc", "ma", "ba", "rn", "jr", "sr", "dphil", "mph", "frcp", "sir", "dame"}
PARTICLES = {"van", "von", "de", "der", "den", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "zu", "af", "av"}
NOBODY = re.compile(r"(?i)^\W*(n/?a|none|null|unknown( author)?|anonymous|anon|et\.? ?al|no author( name)?( given)?|author|various|editor(s|ial)?|collaborators?|staff|not available|-+)?\W*$")
#: Short forms of given names (fixed values, in common use).
NICKNAMES = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "ben": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "liz": "elizabeth", "lisa": "elizabeth", "bill": "william",
    "will": "william", "billy": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "becky": "rebecca", "chris": "christopher", "kit": "christopher", "dan": "daniel", "danny": "daniel",
    "dima": "dimitri", "mitya": "dimitri", "fritz": "friedrich", "gabi": "gabriela", "gaby": "gabriela", "jen": "jennifer", "jenny": "jennifer", "jon": "jonathan", "johnny": "jonathan", "judy": "judith",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "katya": "ekaterina", "katia": "ekaterina", "leo": "leonard", "len": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret",
    "matt": "matthias", "hias": "matthias", "mike": "michael", "mick": "michael", "nick": "nicholas", "klaus": "nicholas", "paco": "francisco", "pancho": "francisco", "curro": "francisco", "pat": "patricia",
    "patty": "patricia", "trish": "patricia", "tricia": "patricia", "beppe": "giuseppe", "peppe": "giuseppe", "pino": "giuseppe", "ros": "rosalind", "roz": "rosalind", "sam": "samuel", "sammy": "samuel",
    "steffi": "stephanie", "steph": "stephanie", "susi": "susanne", "sanne": "susanne", "ted": "theodore", "theo": "theodore", "teddy": "theodore", "tom": "thomas", "tommy": "thomas", "tony": "anthony",
    "ulli": "ulrike", "uli": "ulrike", "rike": "ulrike", "ursel": "ursula", "uschi": "ursula", "vicky": "victoria", "tori": "victoria", "vic": "viktor", "zach": "zachary", "zack": "zachary", "hans": "johannes",
    "hannes": "johannes", "jan": "johannes", "jo": "johannes", "zosia": "zofia", "lucy": "lucia", "lars": "lars", "dave": "david", "jim": "james", "joe": "joseph", "ed": "edward", "greg": "gregory", "andy": "andrew",
}
_LETTERS: dict[str, set[str]] = {}
for _s, _l in NICKNAMES.items():
    _LETTERS.setdefault(_l, {_l[0]}).add(_s[0])

#: Words of organisations' names, in one form each (fixed values).
GENERIC = {
    "university": "university univ uni universidad universite universitat universita universitet universiteit universidade", "hospital": "hospital hosp hopital krankenhaus ospedale",
    "general": "general gen", "college": "college coll", "technology": "technology technol tech", "institute": "institute inst institut instituto istituto", "health": "health hlth",
    "research": "research res", "foundation": "foundation fdn fnd found", "evidence": "evidence evid", "education": "education educ", "medical": "medical med", "centre": "centre center ctr cent",
    "north": "north n nth", "south": "south s sth", "east": "east e", "west": "west w", "school": "school sch", "national": "national natl nat", "international": "international intl int",
    "science": "science sci sciences", "academy": "academy acad", "clinic": "clinic clin", "laboratory": "laboratory lab", "polytechnic": "polytechnic poly",
}
GENERIC = {w: k for k, v in GENERIC.items() for w in v.split()}
LONG_GENERIC = [w for w in GENERIC if len(w) >= 4]
FILLER = {"of", "the", "for", "in", "and", "de", "di", "du", "la", "le", "der", "die", "das", "fur", "von", "at", "et", "y", "del"}
UNIT = re.compile(r"(?i)^\W*(dep\w*|school|faculty|division|unit|section|lab\w*|chair|centre for|center for)\b")
NO_ORG = re.compile(r"(?i)^\W*(n/?a|none|null|unknown|independent( researcher| scholar)?|freelance|retired|self.?employed|private|home|not available|-+)?\W*$")


def fold(s: str) -> str:
    if s.isascii():
        return s
    if "Ã" in s or "Å" in s:  # UTF-8 once read as another encoding
        for enc in ("cp1252", "latin-1"):
            try:
                s = s.encode(enc).decode("utf-8")
                break
            except UnicodeError:
                pass
    s = s.translate({0xDF: "ss", 0xF8: "o", 0xD8: "O", 0x142: "l", 0x141: "L", 0x111: "d"})
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


_SWAPPED = {"".join(sorted(p)) for p in PARTICLES if len(p) == 3}


def _particle(word: str) -> bool:
    """A particle, or one of three letters typed in another order."""
    return word in PARTICLES or len(word) == 3 and "".join(sorted(word)) in _SWAPPED


def person(name: str | None) -> tuple[str, str, str, str] | None:
    """(surname, full given name or '', first initial, middle initials), or None for nobody."""
    if not isinstance(name, str) or NOBODY.match(name):
        return None
    parts = [[w for w in re.findall(r"[^\W\d_]+(?:['’\-.][^\W\d_]+)*\.?", p) if w.lower().strip(".") not in TITLES] for p in fold(name).split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return None
    low = lambda ws: [w.lower().strip(".") for w in ws]
    short = lambda w: len(w.strip(".")) == 1 or bool(re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]?\.?", w))
    if len(parts) > 1:
        sur, given = parts[0], parts[1]
        if all(map(short, sur)) and not all(map(short, given)):
            sur, given = given, sur
    else:
        w = parts[0]
        caps = [x for x in w if len(x.strip(".")) > 2 and x.isupper() and not short(x)]
        if caps and len(caps) < len([x for x in w if not short(x) and not _particle(x.lower())]):
            i = next(k for k, x in enumerate(w) if x in caps)
            while i and _particle(w[i - 1].lower()):
                i -= 1
            j = max(k for k, x in enumerate(w) if x in caps) + 1
            sur, given = w[i:j], w[:i] + w[j:]
        elif len(w) > 1 and not short(w[0]) and (short(w[-1]) or (w[-1].isupper() and len(w[-1]) <= 3)):
            k = len(w)
            while k > 1 and (short(w[k - 1]) or (w[k - 1].isupper() and len(w[k - 1]) <= 3)):
                k -= 1
            sur = w[:k]
            if len(low(sur)) > 1 and not any(map(_particle, low(sur))) and k == len(w) - 1:
                sur, given = w[:1], w[1:]
            else:
                given = list("".join(x.strip(".").replace(".", "") for x in w[k:]))
        else:
            k = len(w) - 1
            while k > 1 and _particle(w[k - 1].lower()):
                k -= 1
            sur, given = w[k:], w[:k]
    sur = [x for x in low(sur) if not _particle(x)] or low(sur)
    surname = re.sub(r"^(al|el)-", "", "".join(sur)).replace("-", "").replace("'", "").replace("’", "").replace(".", "")
    g = [x for w in low(given) for x in (re.split(r"[.]", w) if short(w) else [w]) if x]
    g = [x for x in g if not _particle(x)]
    if not surname:
        return None
    first = NICKNAMES.get(g[0], g[0]) if g else ""
    return surname, first if len(first) > 1 else "", first[:1], "".join(x[0] for x in g[1:])


def _generic(word: str) -> str | None:
    if word in GENERIC:
        return GENERIC[word]
    if len(word) >= 4:
        for g in LONG_GENERIC:
            if abs(len(g) - len(word)) <= 2 and near(word, g, 2 if len(g) >= 9 else 1):
                return GENERIC[g]
    return None


def organisation(text: str | None) -> tuple[str, str, str] | None:
    """(generic words, their initials, proper name) of an affiliation as typed, or None for none."""
    if not isinstance(text, str) or NO_ORG.match(text):
        return None
    segments = [s for s in re.split(r"[,;()\[\]]", fold(text)) if re.search(r"\w", s)]
    main = [s for s in segments if not UNIT.match(s)] or segments
    kinds, names, done = [], [], False
    for seg in main:
        if done:
            break  # a place or country after a complete name
        for w in re.findall(r"[^\W_]+", seg):
            low = w.lower()
            if low in FILLER or not low:
                continue
            g = _generic(low)
            if g:
                kinds.append(g)
            elif w.isupper() and 2 <= len(w) <= 4 and not text.isupper():
                kinds.append("=" + "".join(sorted(low)))
            else:
                names.append(low)
        done = bool(kinds and names)
    if not names:
        return None
    kinds = sorted(set(kinds))
    made = next((k[1:] for k in kinds if k.startswith("=")), "".join(sorted(k[0] for k in kinds)))
    return " ".join(k for k in kinds if not k.startswith("=")), made, "".join(names)


def _order(name: str) -> str:
    """What a name tells of the order of its parts: "," and the given name after a comma, or its two plain words."""
    x = fold(name)
    if m := re.match(r"[^,]+,\s*([^\W\d_]{3,})", x):
        return ", " + m[1].lower()
    w = [y for y in re.findall(r"[^\W\d_]+(?:['’\-.][^\W\d_]+)*\.?", x) if y.lower().strip(".") not in TITLES]
    return " ".join(w).lower() if len(w) == 2 and all(len(y) > 1 and y.isalpha() and not y.isupper() for y in w) else ""


def _mask(given: str, initial: str) -> int | None:
    """The initials that a person so named may be written with, as bits; None if nothing tells."""
    letters = _LETTERS.get(given, {given[0]}) if given else {initial} if initial else ()
    out = 0
    for c in letters:
        out |= 1 << (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 36)
    return out or None


def _parse_people(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("name").to_pylist()
        got = [person(n) for n in texts]
        keep = [i for i, g in enumerate(got) if g]
        if not keep:
            continue
        got = [got[i] for i in keep]
        plain = [_order(texts[i]) for i in keep]
        # two plain words may also stand the other way round
        other = [person(p.replace(" ", ", ")) if " " in p and p[0] != "," else None for p in plain]
        out = {c: batch.column(c).take(pa.array(keep)) for c in batch.schema.names if c != "name"}
        text = lambda values: pa.array(values, pa.string())
        out |= {c: text([g[k] for g in got]) for k, c in enumerate(("surname", "given"))}
        out["mask"] = pa.array([_mask(g[1], g[2]) for g in got], pa.int64())
        out["middle"] = text([g[3] for g in got])
        out["plain"] = text([p[0] if p[:1] == "," else p for p in plain])
        out["surname2"] = text([o[0] if o else None for o in other])
        out["given2"] = text([o[1] if o else p[2:] if p[:1] == "," else None for o, p in zip(other, plain)])
        out["mask2"] = pa.array([_mask(o[1], o[2]) if o else None for o in other], pa.int64())
        yield pa.RecordBatch.from_pydict(out)


def _parse_orgs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [organisation(t) for t in pdf["affiliation"]]
        keep = [i for i, g in enumerate(got) if g]
        if keep:
            yield pd.DataFrame({"affiliation_id": pdf["affiliation_id"].to_numpy()[keep], "affiliation": pdf["affiliation"].to_numpy()[keep], **{c: [got[i][k] for i in keep] for k, c in enumerate(("kinds", "letters", "place"))}})


#: Letters from which a word's slips are looked for in its first and last ``HALF`` letters only.
LONG_WORD, HALF = 64, 32


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Batches ordered by ``key`` as columns whose blocks of equal keys are whole. Only the block under way is held."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: v.to_numpy(zero_copy_only=False) for k, v in zip(batch.schema.names, batch.columns)}
        last = int(np.searchsorted(c[key], c[key][-1]))  # where the block starts that may go on
        if last or held and held[0][key][0] != c[key][0]:
            parts, held = [*held, {k: v[:last] for k, v in c.items()}], []
            yield {k: np.concatenate([x[k] for x in parts]) for k in c}
        held.append({k: v[last:].copy() for k, v in c.items()})
    if held:
        yield {k: np.concatenate([x[k] for x in held]) for k in held[0]}


def _slips(words: DataFrame, word: str, code: str) -> DataFrame:
    """(code, slip): the hashes of each word and of all it becomes by leaving out one letter: two words one slip apart share
    one of them. Of a very long word, itself and its halves."""
    n, i = F.length(word), F.col("i")
    left_out = F.when(n < 4, 0).when(n > LONG_WORD, 2).otherwise(n)
    x = words.select(code, word, F.explode(F.sequence(F.lit(0), left_out)).alias("i"))
    # of a run of one letter, leaving out any gives the same
    x = x.where((i < 2) | (n > LONG_WORD) | (F.substr(word, i, F.lit(1)) != F.substr(word, i - 1, F.lit(1))))
    half = F.when(i == 1, F.concat(F.lit("<"), F.substr(word, F.lit(1), F.lit(HALF)))).otherwise(F.concat(F.lit(">"), F.substr(word, n - HALF + 1, F.lit(HALF))))
    less = F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1))
    return x.select(code, F.xxhash64(F.when(i == 0, F.col(word)).when(n > LONG_WORD, half).otherwise(less)).alias("slip"))


def _shared_slips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _whole(batches, "slip"):
        start = np.flatnonzero(np.r_[True, c["slip"][1:] != c["slip"][:-1]])
        end = np.r_[start[1:], len(c["slip"])]
        keep = np.repeat(c["code"][start] < c["code"][end - 1], end - start) | (c["code"] == c["slip"])
        yield pa.RecordBatch.from_arrays([pa.array(c[k][keep]) for k in ("code", "slip")], names=["code", "slip"])


def _vocabulary(words: DataFrame, word: str, code: str) -> DataFrame:
    """(code, slip): of each word its own hash and those of its slips that another word of the vocabulary has too."""
    w = _slips(words.where(F.length(word) > 0).select(code, word).distinct(), word, code).select(F.col(code).alias("code"), "slip")
    w = w.repartition("slip").sortWithinPartitions("slip", "code").mapInArrow(_shared_slips, "code bigint, slip bigint")
    return materialize(w.withColumnRenamed("code", code), "slips")


#: What a block is judged by: its profiles' given names, first middle initials, ORCIDs, fitting initials and homes.
FACTS = ("g", "m", "o", "mask", "h")
#: Kinds of keys: sure, unless ORCIDs differ; judged; judged without the given name; judged, and at most one home.
SURE, JUDGED, NAMELESS, HOMELESS = range(4)
#: Judged like ``JUDGED``: the first keys of name and organisation, which ``_combined`` makes again.
PLAIN = 4


#: What stands for null among the numbers that blocks are judged by: below every other number.
NONE = -(1 << 63)


def _judged(key: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Of rows ordered by ``key`` with columns f, pid and FACTS, for each block: where it starts, its first profile, its
    ORCID, whether it can only mean one person, and whether it might if it were split by middle initials."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    most = lambda v: np.maximum.reduceat(v, start)
    least = lambda v: np.minimum.reduceat(np.where(v == NONE, -1 - NONE, v), start)
    same = lambda v: ((high := most(v)) == NONE) | (least(v) == high)
    told, f = c["f"] != NAMELESS, np.minimum.reduceat(c["f"], start)
    fits = np.bitwise_and.reduceat(np.where(told & (c["mask"] != NONE), c["mask"], -1), start) != 0
    named = same(np.where(told, c["g"], NONE)) & fits & ((f != HOMELESS) | same(np.where(c["h"] > 0, c["pid"], NONE)))
    a, one_middle, sure = np.minimum.reduceat(c["pid"], start), same(c["m"]), f == SURE
    several, orcid = a < most(c["pid"]), most(c["o"])
    return start, a, orcid, several & same(c["o"]) & (sure | named & one_middle), several & ~sure & named & ~one_middle


def _judge_blocks(batches: Iterator[pa.RecordBatch], singles: bool) -> Iterator[pa.RecordBatch]:
    """Rows ordered by key and pid to those of blocks of several profiles, or to all, each profile once, with the block's
    verdict: the profile ``a`` to be merged into and its ORCID ``ob``, or null."""
    for c in _whole(batches, "key"):
        small = c.pop("small")
        c |= {"f": small & 7, "h": small >> 3 & 1, "m": np.where(small >> 4 == 0, NONE, small >> 4)}
        once = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["pid"][1:] != c["pid"][:-1])]
        c = c if once.all() else {k: v[once] for k, v in c.items()}
        start = np.flatnonzero(np.r_[True, c["key"][1:] != c["key"][:-1]])
        n = np.diff(np.r_[start, len(c["key"])])
        at = np.flatnonzero(np.repeat(n > 1, n))
        to, ob = np.full((2, len(at)), NONE)
        if len(at):
            x = {k: v[at] for k, v in c.items()}
            start, a, orcid, one, mixed = _judged(x["key"], x)
            m = np.diff(np.r_[start, len(at)])
            to, ob = np.repeat(np.where(one, a, NONE), m), np.repeat(np.where(one, orcid, NONE), m)
            split = np.flatnonzero(np.repeat(mixed, m) & (x["m"] != NONE))
            if len(split):
                split = split[np.lexsort((x["m"][split], x["key"][split]))]
                x = {k: v[split] for k, v in x.items()}
                part = np.cumsum(np.r_[True, (x["key"][1:] != x["key"][:-1]) | (x["m"][1:] != x["m"][:-1])])
                start, a, orcid, one, _ = _judged(part, x)
                m = np.diff(np.r_[start, len(part)])
                to[split], ob[split] = np.repeat(np.where(one, a, NONE), m), np.repeat(np.where(one, orcid, NONE), m)
        verdict = np.full((2, len(c["key"])), NONE)
        verdict[:, at] = to, ob
        several = np.repeat(n > 1, n)
        keep = slice(None) if singles else several
        out = [pa.array(c[k][keep]) for k in ("key", "f", "pid")] + [pa.array(v[keep], mask=v[keep] == NONE) for v in verdict] + [pa.array(several[keep])]
        yield pa.RecordBatch.from_arrays(out, names=["key", "f", "pid", "a", "ob", "several"])


def _multi(keys: DataFrame, singles: bool = False) -> DataFrame:
    """(key, f, pid, a, ob, several): of keys (key, f, pid, *FACTS) those of blocks of two or more profiles, judged, or all
    with ``singles``; written. The keys are shuffled once; a task reads a block as a stream and makes no pairs of it."""
    small = (F.col("f") + 8 * F.coalesce("h", F.lit(0)) + 16 * F.coalesce("m", F.lit(0))).cast("bigint").alias("small")
    k = keys.select("key", "pid", *[F.coalesce(c, F.lit(NONE)).alias(c) for c in ("g", "o", "mask")], small)
    k = k.repartition("key").sortWithinPartitions("key", "pid")
    return materialize(k.mapInArrow(lambda x: _judge_blocks(x, singles), "key bigint, f bigint, pid bigint, a bigint, ob bigint, several boolean"), "multi")


def _moves(multi: DataFrame) -> DataFrame:
    """(b, t): profiles of consistent blocks with the smaller profile each is merged into. What a chain leaves apart
    shares its keys again in the next round."""
    tidy(multi.sparkSession)
    per = multi.where("a is not null").groupBy(F.col("pid").alias("b")).agg(F.min("a").alias("a"), F.min("ob").alias("ob"), F.max("ob").alias("ob2"))
    m = materialize(per.where("ob <=> ob2 and a < b").select("b", "a", "ob"), "moves")
    # one jump along chains
    t = m.join(m.select(F.col("b").alias("a"), F.col("a").alias("further")), "a", "left").select("b", F.coalesce("further", "a").alias("t"), "a", "ob")
    clash = t.groupBy("t").agg(F.min("ob").alias("first"), F.max("ob").alias("last")).where("first < last").select("t", "first")
    # a chain that would join two ORCIDs is cut down to the direct neighbours that share the smaller one
    out = materialize(t.join(clash, "t", "left").where("first is null or (ob = first and a = t)").select("b", "t"), "moves")
    release(m)
    return out


def organisations(affiliations: DataFrame) -> DataFrame:
    """(affiliation_id, affiliation, org): spellings of one organisation share ``org``."""
    rows = affiliations.select(F.col("affiliation_id").cast("bigint").alias("affiliation_id"), "affiliation").where("affiliation is not null and affiliation_id is not null")
    parsed = materialize(rows.mapInPandas(_parse_orgs, "affiliation_id bigint, affiliation string, kinds string, letters string, place string"), "orgs")
    words = parsed.select("place", F.xxhash64("place").alias("code"))
    slips = _vocabulary(words.where(F.length("place") >= 5), "place", "code")
    forms = parsed.select(F.col("affiliation_id").alias("pid"), "letters", F.xxhash64("place").alias("code"))
    moved = None
    while True:
        # every combination of a profile's initials and places, acronyms and full names sharing their initials
        f = materialize(forms.distinct(), "forms")
        both = f.select("pid", "letters").distinct().join(f.select("pid", "code").distinct(), "pid")
        keys = both.select("pid", F.xxhash64("letters", "code").alias("key"))
        keys = keys.unionByName(both.join(slips, "code").select("pid", F.xxhash64("letters", F.lit("slip"), "slip").alias("key")))
        centre = keys.groupBy("key").agg(F.min("pid").alias("a"), F.max("pid").alias("z")).where("a < z").select("key", "a")
        step = keys.join(centre, "key").where("pid > a").groupBy(F.col("pid").alias("b")).agg(F.min("a").alias("t"))
        step = materialize(step, "moves")
        if step.isEmpty():
            break
        forms = f.join(step.withColumnRenamed("b", "pid"), "pid", "left").select(F.coalesce("t", "pid").alias("pid"), "letters", "code")
        old, moved = moved, step if moved is None else materialize(_further(moved, step), "moved")
        release(old)
        tidy(f.sparkSession)
    out = parsed.select("affiliation_id", "affiliation")
    if moved is None:
        return out.withColumn("org", F.col("affiliation_id"))
    return out.join(moved.withColumnRenamed("b", "affiliation_id"), "affiliation_id", "left").select("affiliation_id", "affiliation", F.coalesce("t", "affiliation_id").alias("org"))


def _further(moved: DataFrame, step: DataFrame) -> DataFrame:
    """(b, t) after the moves ``moved`` and then ``step``."""
    on = moved.join(step.select(F.col("b").alias("t"), F.col("t").alias("u")), "t", "left").select("b", F.coalesce("u", "t").alias("t"))
    return on.unionByName(step)


def _links(papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """(ordinal, link): what two or more rows share that makes them one work: an id, an identifier, an earlier match.
    Links of links need no closure here, because the profiles that they merge are matched again."""
    p = papers.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.when(F.col("paper_id").isNotNull(), F.xxhash64("paper_id")).alias("paper"), doi_key("doi").alias("doi"), arxiv_key("arxiv_id").alias("arxiv")).where("ordinal is not null")
    a, b = F.xxhash64("paper_id_a"), F.xxhash64("paper_id_b")
    pairs = match_pairs.where("paper_id_a <> paper_id_b").select(F.xxhash64(F.lit("pair"), F.least(a, b), F.greatest(a, b)).alias("link"), F.explode(F.array(a, b)).alias("paper")).distinct()
    shared = F.array("paper", F.when(F.col("doi").isNotNull(), F.xxhash64(F.lit("doi"), "doi")), F.when(F.col("arxiv").isNotNull(), F.xxhash64(F.lit("arxiv"), "arxiv")))
    own = p.select("ordinal", F.explode(shared).alias("link")).where("link is not null")
    all_ = own.unionByName(p.select("ordinal", "paper").join(pairs, "paper").select("ordinal", "link"))
    all_ = materialize(all_, "links")
    many = all_.groupBy("link").agg(F.min("ordinal").alias("o1"), F.max("ordinal").alias("o2")).where("o1 < o2").select("link")
    return all_.join(many, "link")


#: Surnames from which a word that follows a comma is a given name.
KNOWN_BY = 5


def mentions(authors: DataFrame, orgs: DataFrame) -> DataFrame:
    """Parsed author mentions as numbers: (id, ordinal, position, s, head, tail, g, mask, m, o, author, org), and the words
    surname and given. Given names, learned from mentions of the form "Surname, Given", tell the order of two words."""
    by_text = orgs.groupBy("affiliation").agg(F.min("org").alias("org"))
    digits = F.nullif(F.regexp_extract(F.upper("orcid"), r"(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1), F.lit(""))
    author = F.when(F.length(F.trim("author_id")) > 0, F.concat_ws(" ", "database", F.trim("author_id")))
    hashed = lambda x: F.when(x.isNotNull(), F.xxhash64(x))
    a = authors.select(
        F.col("mention_id").cast("bigint").alias("id"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col("author_position").cast("int").alias("position"), "name", "affiliation",
        hashed(author).alias("author"), hashed(digits).alias("o"),
    ).where("name is not null and mention_id is not null")
    a = join_checked(a, by_text, ["affiliation"], "left").drop("affiliation")
    one = "{0} string, {1} string, {2} bigint"
    a = a.mapInArrow(_parse_people, f"id bigint, ordinal bigint, position int, author bigint, o bigint, org bigint, {one.format('surname', 'given', 'mask')}, middle string, plain string, {one.format('surname2', 'given2', 'mask2')}")
    a = materialize(a, "parsed")
    known = a.where("plain = ','").groupBy(F.col("given2").alias("word")).agg(F.approx_count_distinct("surname").alias("n")).where(f"n >= {KNOWN_BY}").select("word", F.lit(True).alias("is"))
    # the words as they stand: of the plain two-word names, the first and the second
    pair = F.split("plain", " ")
    a = a.withColumn("w1", F.when(F.contains(F.col("plain"), F.lit(" ")), pair[0])).withColumn("w2", F.when(F.col("w1").isNotNull(), pair[1]))
    known = materialize(known, "given")
    a = join_checked(a, known.select(F.col("word").alias("w1"), F.col("is").alias("k1")), ["w1"], "left", counted=known)
    a = join_checked(a, known.select(F.col("word").alias("w2"), F.col("is").alias("k2")), ["w2"], "left", counted=known)
    turn = F.col("k2").isNotNull() & F.col("k1").isNull() & F.col("w1").isNotNull()
    pick = lambda c: F.when(turn, F.col(f"{c}2")).otherwise(F.col(c)).alias(c)
    a = a.select("id", "ordinal", "position", "author", "o", "org", pick("surname"), pick("given"), pick("mask"), "middle")
    return materialize(a.select(
        "id", "ordinal", "position", "author", "o", "org", "mask", "surname", "given", F.xxhash64("surname").alias("s"), F.xxhash64(F.substr("surname", F.lit(1), F.lit(3))).alias("head"),
        F.xxhash64(F.lit("tail"), F.substr(F.reverse("surname"), F.lit(1), F.lit(4))).alias("tail"), F.xxhash64(F.substr("surname", F.lit(1), F.lit(2))).alias("start"),
        F.when(F.length("given") > 1, F.xxhash64("given")).alias("g"), F.when(F.length("middle") > 0, F.ascii("middle")).alias("m"),
    ), "mentions")


def _mention_keys(m: DataFrame, links: DataFrame) -> DataFrame:
    """The first keys, of single mentions: identifiers, organisation and name, and the place in a work's author list."""
    k = F.xxhash64
    facts = ["id", "g", "m", "o", "mask"]
    named = F.col("g").isNotNull()
    x = lambda f, key, when: F.when(when, F.struct(F.lit(f).alias("f"), key.alias("key")))
    own = m.select(*facts, F.explode(F.array(
        x(SURE, k(F.lit("orcid"), "o"), F.col("o").isNotNull()), x(SURE, k(F.lit("id"), "author", "start"), F.col("author").isNotNull()),
        x(PLAIN, k(F.lit("at"), "org", "s", "g"), F.col("org").isNotNull() & named),
    )).alias("x")).where("x is not null")
    position = F.coalesce("position", F.lit(-1))
    work = m.join(links, "ordinal").select(*facts, F.explode(F.array(
        x(JUDGED, k(F.lit("work"), "link", position, "head"), F.lit(True)), x(JUDGED, k(F.lit("work"), "link", position, "tail"), F.lit(True)), x(JUDGED, k(F.lit("in"), "link", "s", "g"), named),
    )).alias("x")).where("x is not null")
    return own.unionByName(work).select("x.key", "x.f", F.col("id").alias("pid"), "g", "m", "o", "mask", F.lit(0).alias("h"))


def _attributes(forms: DataFrame) -> DataFrame:
    """(pid, *FACTS): what blocks judge each profile by: its commonest given name and first middle initial, its ORCID,
    the initials that fit, and whether it has a home."""
    # counts decide, hashes break ties; a plain number keeps this a hash aggregation
    by = lambda c: F.when(F.col(c).isNotNull(), F.col("n") * (1 << 20) + F.col(c).bitwiseAND(F.lit((1 << 20) - 1)))
    x = forms.groupBy("pid").agg(
        F.max_by("g", by("g")).alias("g"), F.max_by("mask", by("g")).alias("own"), F.bit_or("mask").alias("any"), F.max_by("m", by("m")).alias("m"), F.min("o").alias("o"),
        F.max(F.when(F.col("org").isNotNull() | F.col("o").isNotNull(), 1).otherwise(0)).alias("h"),
    )
    return x.select("pid", "g", "m", "o", F.when(F.col("g").isNotNull(), F.col("own")).otherwise(F.col("any")).alias("mask"), "h")


def _bits(mask: str, most: int = 4) -> list[Column]:
    """The single bits of a mask, null where there are no more (no name has more initials: ``_LETTERS``)."""
    out, rest = [], F.coalesce(mask, F.lit(0)).cast("bigint")
    for _ in range(most):
        low = rest.bitwiseAND(-rest)
        out.append(F.when(low != 0, low))
        rest = rest.bitwiseXOR(low)
    return out


def _with_bits(own: Column, key: Callable[[Column], Column], mask: str = "mask") -> Column:
    """A row for ``own`` and one for the key of each bit of a mask; most masks have one, and make no more rows."""
    first, *more = [F.when(b.isNotNull(), key(b)) for b in _bits(mask)]
    bits = F.coalesce(mask, F.lit(0)).cast("bigint")
    return F.explode(F.when(bits.bitwiseAND(bits - 1) == 0, F.array(own, first)).otherwise(F.array(own, first, *more)))


def _combined(x: DataFrame, surnames: DataFrame, givens: DataFrame) -> DataFrame:
    """(key, f, and the columns of x but the names): keys of names at organisations, x (pid, s, g, mask, org, ...), with
    slips of the pen."""
    k = F.xxhash64
    rest = [c for c in x.columns if c not in ("s", "org")]
    s = x.join(surnames.withColumnRenamed("code", "s"), "s").select(
        _with_bits(F.when(F.col("g").isNotNull(), k(F.lit("at"), "org", "slip", "g")), lambda b: k(F.lit("letter"), "org", "slip", b)).alias("key"), F.lit(JUDGED).alias("f"), *rest
    ).where("key is not null")
    near_ = givens.withColumnRenamed("code", "g").where("g <> slip or alone = 0").drop("alone")
    g = x.where("g is not null").join(near_, "g").select(k(F.lit("given"), "org", "s", "slip").alias("key"), F.lit(NAMELESS).alias("f"), *rest)
    return s.unionByName(g)


def _names_at(forms: DataFrame, by: str) -> DataFrame:
    """Every name of a profile with every organisation of it."""
    once = lambda df: df.repartition(by).distinct()  # noqa: E731 - one shuffle for this and the join
    return once(forms.select(by, "s", "g", "mask")).join(once(forms.where("org is not null").select(by, "org")), by)


def _new_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of spellings (pid, first, s, g, mask, org) ordered by pid, each profile's names at organisations that none of its
    first profiles had together."""
    for c in _whole(batches, "pid"):
        out: list[tuple] = []
        pids, firsts, orgs, names = (c["pid"].tolist(), c["first"].tolist(), c["org"].tolist(), list(zip(*(c[k].tolist() for k in ("s", "g", "mask")))))
        start = np.flatnonzero(np.r_[True, c["pid"][1:] != c["pid"][:-1]]).tolist()
        for i, j in zip(start, [*start[1:], len(pids)]):
            of: dict[int, tuple[set, set]] = {}
            for k in range(i, j):
                x = of.setdefault(firsts[k], (set(), set()))
                x[0].add(names[k])
                if orgs[k] != NONE:
                    x[1].add(orgs[k])
            have: dict[int, set] = {}
            for n, o in of.values():
                for y in o:
                    have[y] = have[y] | n if y in have else n
            all_ = set().union(*(n for n, _ in of.values()))
            for y, n in have.items():
                out += [(pids[i], *z, y) for z in all_ - n]
                if len(out) > 100_000:
                    yield _numbers(out)
                    out = []
        if out:
            yield _numbers(out)


def _numbers(rows: list[tuple]) -> pa.RecordBatch:
    columns = [np.array(v, np.int64) for v in zip(*rows)]
    return pa.RecordBatch.from_arrays([pa.array(v, mask=v == NONE) for v in columns], names=["pid", "s", "g", "mask", "org"])


def _neighbours(state: _State, forms: DataFrame) -> DataFrame:
    """(sg, other, first): mentions of a name that several profiles have, and who stands up to three places away."""
    names_ = forms.where("g is not null")
    several = names_.groupBy("s", "g").agg(F.min("pid").alias("p1"), F.max("pid").alias("p2")).where("p1 < p2").select("s", "g", F.lit(1).alias("several"))
    x = state.m.select("id", "ordinal", "position", "s", "g", "pid").join(several, ["s", "g"], "left")
    w = Window.partitionBy("ordinal").orderBy("position", "id")
    x = x.select(F.xxhash64(F.lit("with"), "s", "g").alias("sg"), "pid", "several", F.array(*[F.lag("pid", d).over(w) for d in (-3, -2, -1, 1, 2, 3)]).alias("others"))
    return x.where("several = 1").select("sg", F.explode("others").alias("other"), F.col("pid").alias("first")).where("other is not null and other <> first")


class _State:
    """Profiles between rounds: where each mention and first profile went, and the keys made so far."""

    def __init__(self, m: DataFrame, moves: DataFrame, slips: tuple[DataFrame, DataFrame]):
        self.slips = slips
        own = m.select("id", "ordinal", "position", "s", "g", "mask", "m", "o", "org")
        self.m = materialize(own.join(moves.withColumnRenamed("b", "id"), "id", "left").withColumn("pid", F.coalesce("t", "id")).drop("t"), "pids")
        # the spellings of each first profile with their numbers
        facts = self.m.groupBy(F.col("pid").alias("first"), "s", "g", "mask", "m", "o", "org").agg(F.count("*").alias("n"))
        self.facts = materialize(facts, "facts")
        self.at = materialize(self.facts.select("first").distinct().withColumn("pid", F.col("first")), "at")
        self.keys: list[DataFrame] = []  # all keys that may meet new ones
        self.multi: list[DataFrame] = []  # the keys of blocks that several profiles had
        self.fresh = True  # whether blocks were added that no later round has looked at
        self.beside: DataFrame | None = None

    def follow(self, moves: DataFrame) -> DataFrame:
        """Move profiles; (first, pid) of all members of those that changed."""
        old, self.at = self.at, materialize(self.at.join(moves.select(F.col("b").alias("pid"), "t"), "pid", "left").select("first", F.coalesce("t", "pid").alias("pid")), "at")
        release(old)
        return materialize(self.at.join(moves.select(F.col("t").alias("pid")), "pid", "left_semi"), "moved")

    def forms(self, some: DataFrame | None = None) -> DataFrame:
        """The spellings of all profiles, or of some (first, pid)."""
        return self.facts.join(self.at if some is None else some, "first")

    def mentions(self) -> DataFrame:
        return self.m.select("id", F.col("pid").alias("first")).join(self.at, "first").select("id", "pid")


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0].select("key", "f", "first")
    for t in tables[1:]:
        out = out.unionByName(t.select("key", "f", "first"))
    return out


def _first_round(state: _State, rest: DataFrame) -> DataFrame:
    """The moves by names and organisations, and by what is left of the first keys."""
    forms = state.facts.withColumnRenamed("first", "pid")
    facts = materialize(_attributes(forms), "attributes")
    # the names' own given name and initials make the keys; what is judged is the profile's
    x = _names_at(forms, "pid").join(facts.select("pid", *[F.col(c).alias(f"p_{c}") for c in FACTS]), "pid")
    k = _combined(x, *state.slips).select("key", "f", "pid", *[F.col(f"p_{c}").alias(c) for c in FACTS])
    keys = _multi(k.unionByName(rest.join(facts, "pid")), singles=True)
    multi = keys.where("several")
    state.keys.append(keys.select("key", "f", F.col("pid").alias("first")))
    state.multi.append(multi.select("key", "f", F.col("pid").alias("first")))
    release(facts)
    return _moves(multi)


def _weak_round(state: _State) -> DataFrame:
    """The moves by name and neighbour in the author list, and by the name alone."""
    forms = materialize(state.forms(), "forms")
    facts = materialize(_attributes(forms), "attributes")
    state.beside = materialize(_neighbours(state, forms), "beside")
    # only a neighbour that stands beside two mentions can link them
    often = forms.groupBy("pid").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("pid").alias("to"))
    at = state.at.select(F.col("first").alias("other"), F.col("pid").alias("to")).join(often, "to")
    beside = state.beside.join(at, "other").join(state.at, "first").select(F.xxhash64("sg", "to").alias("key"), F.lit(JUDGED).alias("f"), "pid").repartition("pid").distinct()
    k = F.xxhash64
    alone = forms.select("pid", "s", "g", "mask").repartition("pid").distinct().select(
        _with_bits(F.when(F.col("g").isNotNull(), k(F.lit("name"), "s", "g")), lambda b: k(F.lit("short"), "s", b)).alias("key"), F.lit(HOMELESS).alias("f"), "pid"
    ).where("key is not null")
    multi = _multi(beside.join(facts, "pid").unionByName(alone.join(facts, "pid")))
    state.multi.append(multi.select("key", "f", F.col("pid").alias("first")))
    state.fresh = True
    for x in (forms, facts):
        release(x)
    return _moves(multi)


def _later_round(state: _State, moved: DataFrame) -> DataFrame:
    """The moves in the blocks of the profiles that changed, with the keys of their new combinations. The tables that say
    what is looked at are written, so Spark knows their size and broadcasts what is under its own threshold."""
    forms = state.forms(moved).select(*[F.coalesce(F.col(c).cast("bigint"), F.lit(NONE)).alias(c) for c in ("pid", "first", "s", "g", "mask", "org")])
    x = forms.repartition("pid").sortWithinPartitions("pid").mapInArrow(_new_names, "pid bigint, s bigint, g bigint, mask bigint, org bigint")
    x = materialize(x, "names")
    # few rows end in one file, so that later rounds read them in one task
    new = materialize(_combined(x, *state.slips).select("key", "f", "pid").repartition("key"), "keys")
    multi = _united(state.multi)
    shared = materialize(multi.select("key", "first").join(moved.select("first"), "first", "left_semi").select("key").distinct(), "shared")
    touched = multi.join(shared, "key", "left_semi")
    if state.fresh:  # most blocks are touched once: what is left of them is added below
        state.multi, state.fresh = [materialize(multi.join(shared, "key", "left_anti"), "untouched")], False
    rows = touched.unionByName(_united(state.keys).join(new.select("key"), "key", "left_semi"))
    if state.beside is not None:
        to = moved.select(F.col("first").alias("other"), F.col("pid").alias("to"))
        rows = rows.unionByName(state.beside.join(to, "other").select(F.xxhash64("sg", "to").alias("key"), F.lit(JUDGED).alias("f"), "first"))
    k = materialize(rows.join(state.at, "first").select("key", "f", "pid").unionByName(new).distinct(), "rows")
    looked_at = materialize(state.at.join(k.select("pid").distinct(), "pid", "left_semi"), "members")
    out = _multi(k.join(_attributes(state.forms(looked_at)), "pid"))
    state.multi.append(out.select("key", "f", F.col("pid").alias("first")))
    state.keys.append(new.withColumnRenamed("pid", "first"))
    for y in (moved, x, shared, k, looked_at):
        release(y)
    return _moves(out)


def people(m: DataFrame, links: DataFrame) -> DataFrame:
    """(id, pid): the mentions of one person share ``pid``."""
    words = _vocabulary(m, "surname", "s").withColumnRenamed("s", "code")
    givens = _vocabulary(m.where("g is not null"), "given", "g").withColumnRenamed("g", "code")
    # a given name that is like no other has no key for slips
    alone = givens.groupBy("code").agg(F.when(F.count("*") == 1, 1).otherwise(0).alias("alone"))
    givens = materialize(givens.join(alone, "code"), "givens")
    tidy(m.sparkSession)
    multi = _multi(_mention_keys(m, links))
    state = _State(m, _moves(multi), (words, givens))
    # identifiers and works stay keys where they did not merge all at once; later rounds make no more of them
    rest = multi.where(F.col("f") != PLAIN).select("key", "f", F.col("pid").alias("id")).join(state.m.select("id", "pid"), "id").select("key", "f", "pid").distinct()
    moves = _first_round(state, rest)
    weak = False
    while True:
        tidy(m.sparkSession)
        if not moves.isEmpty():
            moves = _later_round(state, state.follow(moves))
        elif not weak:  # from here on weak and strong keys are tried together
            weak = True
            moves = _weak_round(state)
        else:
            return state.mentions()


def entity_pairs(groups: DataFrame, kind: str) -> DataFrame:
    """All pairs of the ids that share an entity: the form that the result has."""
    g = groups.select("id", "pid")
    return g.select(F.col("id").alias("id_a"), "pid").join(g.select(F.col("id").alias("id_b"), "pid"), "pid").where("id_a < id_b").select(F.lit(kind).alias("kind"), "id_a", "id_b")


def _resolved(authors: DataFrame, orgs: DataFrame, papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    m, links = mentions(authors, orgs), materialize(_links(papers, match_pairs), "links")
    out = people(m, links)
    release(links)
    return out


def same_names(authors: DataFrame, affiliations: DataFrame, papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """p3_found."""
    orgs = materialize(organisations(affiliations), "organisations")
    who = materialize(_resolved(authors, orgs, papers, match_pairs), "people")
    return entity_pairs(who, "person").unionByName(entity_pairs(orgs.select(F.col("affiliation_id").alias("id"), F.col("org").alias("pid")), "organisation"))


def person_groups(authors: DataFrame, affiliations: DataFrame, papers: DataFrame, match_pairs: DataFrame) -> DataFrame:
    """(mention_id, person_id) of every mention of somebody."""
    who = _resolved(authors, materialize(organisations(affiliations), "organisations"), papers, match_pairs)
    return who.select(F.col("id").alias("mention_id"), F.col("pid").alias("person_id"))
