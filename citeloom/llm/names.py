"""Variant spellings of hand-typed names of persons and organisations, linked by a pigeonhole segment join.

A name within k edits of another has, cut into k + 1 segments, at least one segment that the other holds unchanged, at
most k places away. So the segments of all names make an inverted index, in which the names' shifted substrings are
looked up; what is found is verified by a banded edit distance. Surnames, given names and the words of institutions all
go this way; mentions then meet by equality of what their parts were found to be alike to, never surname by surname.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.graph import components
from citeloom.operators.skew import skew_join
from citeloom.session import materialise, ship

EDITS = 2
#: Rows of an entity that one task pairs with as many others.
PAIR_BLOCK = 1024

# Usual short forms of given names. Forms that are the beginning of the name need no entry.
SHORT_FORMS = {
    "alexander": "sasha xander sandy", "william": "bill billy liam", "robert": "bob bobby bert robbie", "richard": "dick rick ricky",
    "theodore": "ted teddy", "thomas": "tom tommy", "edward": "ed eddie ned", "daniel": "danny", "michael": "mike mick mickey", "nicholas": "nick nico",
    "christopher": "kit topher", "stephen": "steve steven", "james": "jim jimmy", "john": "jack johnny", "joseph": "joe", "jose": "pepe",
    "johannes": "hans jan hannes", "giovanni": "gianni vanni", "oluwaseun": "seun", "mohammed": "mo muhammad mohammad", "anthony": "tony",
    "rebecca": "becky becca", "elizabeth": "beth liz lizzie betty betsy lisa", "deborah": "debbie debra", "jennifer": "jenny",
    "katherine": "kate kathy katie cathy catherine kathryn kitty", "margaret": "maggie meg peggy marge", "patricia": "patty trish tricia",
    "susan": "sue susie suzy", "victoria": "vicky vicki tori", "francesca": "franny cesca", "birgitta": "gitta britta", "agnieszka": "aga",
    "yelena": "lena elena", "david": "dave", "annemarie": "annie",
}
NICKNAMES = {short: full for full, shorts in reversed(SHORT_FORMS.items()) for short in shorts.split()}
# Words that name the kind of an institution, with their short forms.
KINDS = {
    "university": "university univ u uni universitat universite", "hospital": "hospital hosp hospitals", "institute": "institute inst institut", "medical": "medical med medicine medicinal",
    "center": "center centre ctr cntr cent", "research": "research res rsch", "general": "general gen", "saint": "saint st", "childrens": "childrens children child", "department": "department dept dep",
    "division": "division div", "section": "section sect", "clinic": "clinic clin", "college": "college coll", "school": "school sch", "foundation": "foundation found fdn",
}
# Words of companies; the kind of business is part of the name, the rest is not.
COMPANY = {"pharmaceuticals": "pharm pharma pharmaceutical pharmaceuticals", "therapeutics": "thera ther therapeutics therapeutic", "biosciences": "biosc biosci bioscience biosciences", "biotech": "biotech biotechnology biotechnologies", "laboratories": "lab labs laboratory laboratories"}
# Usual initials of two such words.
INITIALS = {"mc": ("medical", "center"), "uh": ("university", "hospital"), "gh": ("general", "hospital"), "rc": ("research", "center"), "ch": ("childrens", "hospital")}
# Words that name a part of an institution when they begin or end what stands between two marks.
UNITS = frozenset("department division section unit ward service services office program programme branch campus".split())
_EMPTY = frozenset("of the and at for de la du s main campus usa us uk canada germany france spain italy japan china india brazil kenya australia israel mexico sweden denmark poland netherlands switzerland austria belgium".split())
_DEGREE_WORDS = re.compile(r"(?:[,;]\s*|\s+)(?:M\.?D\.?|Ph\.?\s?D\.?|MPH|M\.?Sc\.?|FRCP|FACP|MBBS|D\.?O\.?|R\.?N\.?|Pharm\.?D\.?|Jr\.?|Sr\.?|III?)(?=[\s,;.]|$)", re.IGNORECASE)
_TITLES = re.compile(r"^(?:dr|prof|professor|mr|mrs|ms)\.?\s+", re.IGNORECASE)
_LETTERS = str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})
_FORM = {w: k for table in (KINDS, COMPANY) for k, words in table.items() for w in words.split()}


def fold(text: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(_LETTERS)) if not unicodedata.combining(c))


def near(a: str, b: str, most: int) -> bool:
    """Whether a and b are at most `most` edits apart, a swap of neighbours being one (within a band of the diagonal)."""
    if abs(len(a) - len(b)) > most:
        return False
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(low, high + 1):
            new[j] = min(row[j - 1] + (x != b[j - 1]), row[j] + 1, new[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                new[j] = min(new[j], before[j - 2] + 1)
        if min(new[low - 1 : high + 1]) > most:
            return False
        before, row = row, new
    return row[-1] <= most


def _form(word: str, kept: dict[str, str]) -> str:
    """The full form of an institution's word, also where it is mistyped; other words as they are."""
    if word not in kept:
        form = _FORM.get(word)
        if form is None and len(word) >= 4:
            form = next((full for full in (*KINDS, *COMPANY) if len(full) >= 5 and near(word, full, 1)), None)
        kept[word] = form or word
    return kept[word]


def institution(text: str | None, kept: dict[str, str]) -> tuple[str, str] | None:
    """(own words, kind words) of an affiliation, each sorted; None if nothing is left. Departments and other parts of an
    institution that stand apart from its name are left out."""
    if not text:
        return None
    own: list[str] = []
    kinds: set[str] = set()
    for part in re.split(r"[,;()]", fold(text).replace("'", "").replace("’", "")):
        words = [_form(w, kept) for w in re.findall(r"[a-z0-9]+", part)]
        if words and (words[0] in UNITS or words[-1] in UNITS):
            continue
        for w in words:
            if w in KINDS or w in COMPANY:
                kinds.add(w)
            elif w in INITIALS:
                kinds.update(INITIALS[w])
            elif w not in _EMPTY:
                own.append(w)
    return (" ".join(sorted(own)), " ".join(sorted(kinds))) if own else None


def company(text: str, kept: dict[str, str]) -> tuple[str, str] | None:
    """(own words, business) of an organisation's name, or None if the text has no word of a company or institution."""
    words = [_form(w, kept) for w in re.findall(r"[a-z0-9]+", fold(text).replace("'", ""))]
    for i, w in enumerate(words):
        if w in COMPANY and i:
            return " ".join(words[:i]), w
    for w in words:
        if w in ("university", "hospital", "institute", "center", "clinic", "college", "foundation") and len(words) > 1:
            return institution(text, kept)
    return None


def _tokens(text: str | None) -> list[str]:
    """The words of a person's name, without degrees and titles; parts joined by a hyphen are one word."""
    if not text:
        return []
    text = _TITLES.sub("", text.strip())
    text = _DEGREE_WORDS.sub("", text)
    return re.findall(r"[^\W\d_]+", fold(text).replace("-", "").replace("'", "").replace("’", ""))


def name_parts(first: str | None, last: str | None) -> tuple[str, str, str]:
    """(front, back, how): what stands where the given name and the surname are meant to, and how sure that is.

    how: fields (two fields, which may be swapped), comma (surname, given name in one), loose (two words in one field, in
    either order), sure (a single name, or an initial beside one word).
    """

    def joined(words: list[str]) -> str:
        long = [w for w in words if len(w) > 1]
        return "".join(long) if long else (words[0] if words else "")

    front = _tokens(first)
    plain = _DEGREE_WORDS.sub("", last or "").strip(" ,;")
    if "," in plain and not front:
        a, _, b = plain.partition(",")
        return joined(_tokens(b)), joined(_tokens(a)), "comma"
    back = _tokens(plain)
    if front:
        return joined(front), joined(back), "fields"
    if len(back) < 2:
        return "", joined(back), "sure"
    initials, long = [w for w in back if len(w) == 1], [w for w in back if len(w) > 1]
    if len(long) < 2:
        return (initials[0] if initials else ""), joined(long), "sure"
    return joined(long[:-1]), long[-1], "loose"


def _meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """left and right joined by sorting both, so that neither is gathered on the driver to be broadcast. Left to itself the
    engine judges a side by the compressed file that it is read from, as it is before its words are cut into segments, and
    takes for small what is many times larger."""
    return left.join(right.hint("merge"), on, how)


def _parsed(df: DataFrame, key: str, first: str, last: str, affiliation: str, nicknames: dict[str, str]) -> DataFrame:
    """id, kind, front, back, how, place, sort: the parts of each mention; place is null without affiliation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms: dict[str, str] = {}
        for batch in batches:
            out = []
            for key_value, f, l, a in batch.itertuples(index=False, name=None):
                f, l, a = (x if isinstance(x, str) and x.strip() else None for x in (f, l, a))
                firm = company(l, forms) if l and not f else None
                if firm:
                    out.append((key_value, "organisation", firm[1], firm[0].replace(" ", ""), "sure", None, None))
                    continue
                front, back, how = name_parts(f, l)
                place = institution(a, forms)
                out.append((key_value, "person", nicknames.get(front, front), back, how, *(place or (None, None))))
            yield pd.DataFrame(out, columns=["id", "kind", "front", "back", "how", "place", "sort"])
            if len(forms) > 500_000:
                forms.clear()

    rows = df.select(F.col(key).cast("long").alias("id"), *(F.col(c).cast("string").alias(n) for c, n in ((first, "f"), (last, "l"), (affiliation, "a")))).filter("id is not null")
    return rows.mapInPandas(run, "id long, kind string, front string, back string, how string, place string, sort string")


def _oriented(parsed: DataFrame, nicknames: dict[str, str]) -> DataFrame:
    """id, kind, name, given, place, sort: given names told from surnames where the fields may be swapped.

    Of each word it is counted over all rows how often it stands in front and at the back. A row is turned round if its
    back word is more of a given name, by these counts without the row itself, than its front word.
    """
    full = F.col("back")
    if nicknames:
        full = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in nicknames.items() for x in pair)), full), full)
    rows = parsed.withColumn("given_back", full).withColumn("counted", F.col("how").isin("fields", "comma").cast("long"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    open_row = F.col("how").isin("fields", "loose") & (F.col("front") != "") & (F.col("back") != "")
    person = rows.filter(open_row)
    told = rows.filter("kind = 'person'").select(
        F.explode(
            F.array(
                F.struct(F.col("front").alias("word"), F.col("counted").alias("ahead"), zero.alias("behind"), open_row.cast("long").alias("n_front"), zero.alias("n_back")),
                F.struct(F.col("given_back").alias("word"), zero.alias("ahead"), F.col("counted").alias("behind"), zero.alias("n_front"), open_row.cast("long").alias("n_back")),
            )
        ).alias("w")
    ).select("w.*")
    counts = materialise(told.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("ahead", "behind", "n_front", "n_back"))))
    total = person.agg(F.count(one).alias("n"))

    def side(c: str, name: str, n: str) -> DataFrame:
        return counts.filter(F.col(n) > 0).select(F.col("word").alias(c), F.col("ahead").alias(f"ahead_{name}"), F.col("behind").alias(f"behind_{name}"), n)

    # Each join is a plan of its own. The hint holds for the keys that are not hot; those have one of their own.
    met = materialise(skew_join(person, side("front", "f", "n_front").hint("merge"), "front", "n_front", total))
    met = skew_join(met, side("given_back", "b", "n_back").hint("merge"), "given_back", "n_back", total)

    def score(ahead: Column, behind: Column) -> Column:
        return (ahead + 0.5) / (behind + 0.5)

    of_front = score(F.col("ahead_f") - F.col("counted"), F.col("behind_f"))
    of_back = score(F.col("ahead_b"), F.col("behind_b") - F.col("counted"))
    turned = (F.length("front") > 1) & ((F.length("back") == 1) | (of_back > 2 * of_front))
    columns = ("kind", "place", "sort")
    open_rows = met.select("id", *columns, F.when(turned, F.col("front")).otherwise(F.col("back")).alias("name"), F.when(turned, F.col("given_back")).otherwise(F.col("front")).alias("given"))
    rest = rows.filter(~open_row)
    lone = F.when((F.col("back") == "") & (F.col("kind") == "person"), F.col("front")).otherwise(F.col("back"))
    closed = rest.select("id", *columns, lone.alias("name"), F.when((F.col("back") == "") & (F.col("kind") == "person"), F.lit("")).otherwise(F.col("front")).alias("given"))
    return open_rows.unionByName(closed).filter("name != ''").select("id", "kind", "name", "given", "place", "sort")


def segment_pairs(names: DataFrame, name: str = "name", edits: int = EDITS) -> DataFrame:
    """name_1, name_2: all pairs of distinct non-empty names at most edits apart (Levenshtein), name_1 < name_2.

    Index: the edits + 1 segments of a name of length n, even in length, by (n, number, segment). Probe: for each length
    that another name can have, the substrings at most edits places from each segment's own. Names shorter than the
    number of segments have empty segments, which match; so they meet all names of about their length.
    """
    distinct = names.select(F.col(name).alias("name")).filter("name != ''").distinct()
    parts = edits + 1
    n = F.length("name")

    def start(length: Column, i: Column) -> Column:
        return F.floor(length * i / parts).cast("int")

    numbers = F.sequence(F.lit(0), F.lit(edits))
    index = distinct.select("name", n.alias("n"), F.explode(numbers).alias("i")).select("name", "n", "i", F.expr("substring(name, cast(floor(n * i / {0}) as int) + 1, cast(floor(n * (i + 1) / {0}) as int) - cast(floor(n * i / {0}) as int))".format(parts)).alias("segment"))
    probe = distinct.select("name", F.explode(F.sequence(F.greatest(F.lit(1), n - edits), n)).alias("n"), n.alias("own")).select("*", F.explode(numbers).alias("i"))
    at, to = start(F.col("n"), F.col("i")), start(F.col("n"), F.col("i") + 1)
    probe = probe.withColumn("at", at).withColumn("size", to - at)
    probe = probe.select("name", "n", "i", "size", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - edits), F.greatest(F.lit(0), F.least(F.col("at") + edits, F.col("own") - F.col("size"))))).alias("s"))
    probe = probe.select("name", "n", "i", F.expr("substring(name, s + 1, size)").alias("segment")).distinct()
    met = _meet(probe.withColumnRenamed("name", "b"), index.withColumnRenamed("name", "a"), ["n", "i", "segment"]).filter("a != b")
    both = met.select(F.least("a", "b").alias("name_1"), F.greatest("a", "b").alias("name_2")).distinct()
    return both.filter(F.levenshtein("name_1", "name_2", edits) >= 0)


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def similar(words: DataFrame, edits: int = EDITS) -> DataFrame:
    """name_1, name_2: the words (column name) with those they are alike to, both ways, themselves included.

    Words of 5 letters or more may be `edits` apart, those of 3 or 4 letters one edit or one swap of letters; shorter ones
    are alike to nothing else, as any other short word is a few edits away.
    """
    distinct = materialise(words.select("name").filter("name != ''").distinct())
    n = F.length("name")
    long = materialise(segment_pairs(distinct.filter(n >= 5), "name", edits))
    short = materialise(segment_pairs(distinct.filter(n.between(3, 5)), "name", 1).filter(F.least(F.length("name_1"), F.length("name_2")) <= 4))
    few = distinct.filter(n.between(3, 4)).select("name", _letters(F.col("name")).alias("letters"))
    swapped = _meet(few.withColumnRenamed("name", "name_1"), few.withColumnRenamed("name", "name_2"), "letters").filter((F.col("name_1") < F.col("name_2")) & (F.levenshtein("name_1", "name_2", 2) >= 0))
    pairs = reduce(DataFrame.unionByName, (long, short, swapped.select("name_1", "name_2"))).distinct()
    same = distinct.select(F.col("name").alias("name_1"), F.col("name").alias("name_2"))
    either = F.array(F.struct("name_1", "name_2"), F.struct(F.col("name_2").alias("name_1"), F.col("name_1").alias("name_2")))
    return materialise(pairs.select(F.inline(either)).unionByName(same))


def _alike(a: Column, b: Column) -> Column:
    """What similar() says, of two words."""
    short = F.least(F.length(a), F.length(b))
    return (a == b) | F.when(short >= 5, F.levenshtein(a, b, 2) >= 0).otherwise((short >= 3) & ((F.levenshtein(a, b, 1) >= 0) | ((_letters(a) == _letters(b)) & (F.levenshtein(a, b, 2) >= 0))))


def _given_fits(a: Column, b: Column) -> Column:
    short = F.least(F.length(a), F.length(b))
    initial = (short <= 1) & ((short == 0) | (F.substring(a, 1, 1) == F.substring(b, 1, 1)))
    return initial | (a == b) | ((short >= 4) & _alike(a, b)) | ((short >= 3) & (a.startswith(b) | b.startswith(a)))


def given_pairs(given: DataFrame, alike: DataFrame) -> DataFrame:
    """given_1, given_2: the given names (column name, no initials) that may fit each other, both ways, themselves
    included. alike: similar() of a vocabulary that holds them."""
    full = given.select("name").filter("length(name) > 1").distinct()
    alike = alike.select(F.col("name_1").alias("given_1"), F.col("name_2").alias("given_2"))
    cut = full.filter("length(name) > 3").select(F.col("name").alias("given_1"), F.explode(F.sequence(F.lit(3), F.length("name") - 1)).alias("k")).select("given_1", F.expr("left(given_1, k)").alias("given_2"))
    begun = _meet(cut, full.select(F.col("name").alias("given_2")), "given_2").select("given_1", "given_2")
    return alike.unionByName(begun).unionByName(begun.select(F.col("given_2").alias("given_1"), F.col("given_1").alias("given_2"))).distinct()


def _same_words(a: Column, b: Column) -> Column:
    """Whether each word of more than 3 letters of either text is alike to one of the other."""

    def held(x: Column, y: Column) -> Column:
        return F.forall(F.split(x, " "), lambda w: (F.length(w) <= 3) | F.exists(F.split(y, " "), lambda v: _alike(w, v)))

    return (a == b) | (held(a, b) & held(b, a) & (F.length(a) > 3) & (F.length(b) > 3))


def place_words(places: DataFrame) -> DataFrame:
    """place, name: the words of more than 3 letters of each institution (own words, column place)."""
    return places.select("place").filter("place is not null").distinct().select("place", F.explode(F.array_distinct(F.split("place", " "))).alias("name")).filter("length(name) > 3")


def place_pairs(places: DataFrame, words: DataFrame, alike: DataFrame) -> DataFrame:
    """place_1, place_2: the institutions that are alike, both ways, themselves included. words: their place_words;
    alike: similar() of a vocabulary that holds these.

    A place meets others by its rarest word: another place alike to it holds that word or one alike to it.
    """
    rarest = _meet(words, words.groupBy("name").agg(F.count(F.lit(1)).alias("n")), "name").groupBy("place").agg(F.min_by("name", F.struct("n", "name")).alias("name_1"))
    met = _meet(_meet(rarest.withColumnRenamed("place", "place_1"), alike, "name_1"), words.select(F.col("place").alias("place_2"), F.col("name").alias("name_2")), "name_2")
    found = met.select("place_1", "place_2").distinct().filter(_same_words(F.col("place_1"), F.col("place_2")))
    return found.unionByName(places.filter("place is not null").select(F.col("place").alias("place_1"), F.col("place").alias("place_2"))).distinct()


_PARTS = ("m", "name", "given", "place", "sort", "n")


def _fits() -> Column:
    """Whether two mentions whose names are alike fit each other in the rest."""
    person = F.col("kind") == "person"
    places = F.col("place_1").isNotNull() & F.col("place_2").isNotNull()
    sort = (F.col("sort_1") == F.col("sort_2")) | (F.levenshtein("sort_1", "sort_2", 3) >= 0)
    same_place = ~places | (_same_words(F.col("place_1"), F.col("place_2")) & sort)
    sure = (F.col("name_1") == F.col("name_2")) | (F.least(F.length("name_1"), F.length("name_2")) > 4) | (places & (F.col("given_1") == F.col("given_2")) & (F.length("given_1") > 1))
    return F.when(person, _given_fits(F.col("given_1"), F.col("given_2")) & same_place & sure).otherwise(F.col("given_1") == F.col("given_2"))


def _side(mentions: DataFrame, number: int) -> DataFrame:
    return mentions.select("kind", *(F.col(c).alias(f"{c}_{number}") for c in _PARTS))


def _by_letter(left: DataFrame, right: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of mentions that meet by name and first letter of the given name, or by name alone where one has none."""
    letter = F.substring("given_1", 1, 1)
    probes = F.when(F.col("given_1") == "", F.array(F.lit("*"))).otherwise(F.array(letter, F.lit("")))
    a = _meet(left, names, "name_1").withColumn("key", F.explode(probes))
    b = right.withColumn("key", F.explode(F.array(F.substring("given_2", 1, 1), F.lit("*"))))
    return _meet(a, b, ["kind", "name_2", "key"]).filter(_fits()).select("m_1", "m_2", "n_2")


def _heads(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """m, entity: the mentions of pairs (both ways, each with itself), each with the head of its entity.

    A mention points to the one of most rows that it fits, of equal ones to that which fits most others; pointers are
    followed until nothing changes. Entities of which two mentions fit each other are one, if their heads do not
    contradict each other.
    """
    degree = pairs.groupBy(F.col("m_1").alias("m_2")).agg(F.count(F.lit(1)).alias("d_2"))
    at = materialise(_meet(pairs, degree, "m_2").groupBy("m_1").agg(F.max_by("m_2", F.struct("n_2", "d_2", "m_2")).alias("head")))
    while True:
        up = at.select(F.col("m_1").alias("head"), F.col("head").alias("top"))
        new = materialise(_meet(at, up, "head").select("m_1", "head", "top"))
        still = new.filter("head != top").isEmpty()
        at = new.select("m_1", F.col("top").alias("head"))
        if still:
            break
    one, two = at.select("m_1", F.col("head").alias("h_1")), at.select(F.col("m_1").alias("m_2"), F.col("head").alias("h_2"))
    across = _meet(_meet(pairs, one, "m_1"), two, "m_2").filter("h_1 < h_2").select(F.col("h_1").alias("m_1"), F.col("h_2").alias("m_2")).distinct()
    met = _meet(_meet(materialise(across), _side(mentions, 1), "m_1"), _side(mentions, 2), ["kind", "m_2"]).filter(_fits() & (F.levenshtein("name_1", "name_2", 2 * EDITS) >= 0))
    links = materialise(met.select(F.col("m_1").alias("citing"), F.col("m_2").alias("cited")))
    out = at.select(F.col("m_1").alias("m"), F.col("head").alias("entity"))
    if links.isEmpty():
        return out
    joined = components(links).withColumnRenamed("node", "entity")
    return materialise(_meet(out, joined, "entity", "left").select("m", F.coalesce("component", "entity").alias("entity")))


def link_names(df: DataFrame, key: str, first: str, last: str, affiliation: str, edits: int = EDITS, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """entity, key: the rows of each person or organisation; a row that fits several entities is in each.

    Surnames (or the own words of an organisation's name) are alike as similar() says, given names equal, alike, short
    forms or initials of one another, and institutions alike or missing; a surname of up to 4 letters may differ only
    where given name and institution are both there and the given names equal. The fields may be swapped or hold both
    parts, with degrees, accents and reordered parts. Of equal mentions one stands for all; see _heads for how mentions
    make an entity, also in chains of misspellings. Mentions without affiliation or with an initial only join each entity
    they fit and do not join entities to each other; those that fit none make entities among themselves.

    Mentions meet by equality: those with an institution by (name, place), those with a given name only by (name, given
    name), over what names, places and given names were found to be alike to; a frequent surname alone is never a key but
    for mentions that have nothing else.

    Keys are whole numbers. Null keys and rows without any name give no row; repeated rows of a key are one. Extra
    columns are ignored, an empty df gives no rows.
    """
    ship(df.sparkSession)
    parts = ["kind", "name", "given", "place", "sort"]
    mention = F.xxhash64(*(F.coalesce(F.col(c), F.lit("\0")) for c in parts)).alias("m")
    parsed = materialise(_parsed(df, key, first, last, affiliation, nicknames))
    rows = materialise(_oriented(parsed, nicknames).distinct().select("id", *parts, mention))
    person = F.col("kind") == "person"
    mentions = materialise(rows.groupBy("m", *parts).agg(F.count(F.lit(1)).alias("n")).withColumn("weak", person & (F.col("place").isNull() | (F.length("given") <= 1))))
    words, given = materialise(place_words(mentions)), mentions.filter(person).select(F.col("given").alias("name"))
    alike = similar(mentions.select("name").unionByName(words.select("name")).unionByName(given.filter("length(name) > 1")), edits)
    names = materialise(_meet(alike, mentions.select(F.col("name").alias("name_1")).distinct(), "name_1", "left_semi"))
    places, givens = materialise(place_pairs(mentions, words, alike)), materialise(given_pairs(given, alike))
    one, two = _side(mentions, 1), _side(mentions.filter("not weak"), 2)
    anchored = _meet(_meet(_meet(one.filter("place_1 is not null"), names, "name_1"), places, "place_1"), two, ["kind", "name_2", "place_2"])
    firms = _meet(_meet(one.filter("kind = 'organisation'"), names, "name_1").withColumn("given_2", F.col("given_1")), two, ["kind", "name_2", "given_2"])
    bare = one.filter("kind = 'person' and place_1 is null")
    named = _meet(_meet(_meet(bare.filter("length(given_1) > 1"), names, "name_1"), givens, "given_1"), two, ["kind", "name_2", "given_2"])
    met = [d.filter(_fits()).select("m_1", "m_2", "n_2") for d in (anchored, firms, named)]
    met.append(_by_letter(bare.filter("length(given_1) <= 1"), two, names))
    # Each way to meet is written by itself: what the driver keeps of a plan grows with the square of its size.
    pairs = materialise(reduce(DataFrame.unionByName, map(materialise, met)).distinct())
    weak = mentions.filter("weak").select(F.col("m").alias("m_1"))
    heads = _heads(materialise(_meet(pairs, weak, "m_1", "left_anti")), mentions)
    joined = _meet(_meet(pairs, weak, "m_1", "left_semi"), heads.select(F.col("m").alias("m_2"), "entity"), "m_2").select(F.col("m_1").alias("m"), "entity")
    joined = materialise(joined.distinct())
    alone = materialise(_meet(mentions.filter("weak"), joined.select("m"), "m", "left_anti"))
    rest = _heads(materialise(_by_letter(_side(alone, 1), _side(alone, 2), names).distinct()), mentions)
    members = heads.unionByName(joined).unionByName(rest)
    return materialise(_meet(rows.select("id", "m"), members, "m").select("entity", F.col("id").alias(key)).distinct())


def linked_pairs(members: DataFrame, key: str, block: int = PAIR_BLOCK) -> DataFrame:
    """id_1, id_2: all pairs of rows of one entity, id_1 < id_2. A large entity is cut into blocks, each two of which meet
    in a task of their own."""
    sizes = members.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = _meet(members, sizes, "entity").select("entity", F.col(key).alias("id"), "blocks", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rows.select("entity", F.col("id").alias("id_1"), F.col("own").alias("p"), every.alias("q"))
    two = rows.select("entity", F.col("id").alias("id_2"), F.col("own").alias("q"), every.alias("p"))
    return _meet(one, two, ["entity", "p", "q"]).filter("id_1 < id_2").select("id_1", "id_2").distinct()
