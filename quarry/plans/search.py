"""Query compiler: a parsed query becomes one wide projection over record columns, a filter and a top-k.

hit = seeded and predicate. All signals are boolean or integer columns of one row, so the plan is a scan, a join with the
positions of the few query terms, a filter and TakeOrderedAndProject; the only other job is the count that decides the
substring fallback when it is left to the limit.

With a stored index the scan is replaced by candidates: the ids of the postings that some signal or seed of the query
reads, each looked up by its keys; only their records are scored. Candidates are a superset, so hits are the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.functions.text import python_tokens
from quarry.operators.index import ID, Index

from quarry.operators.storage import stored

from .query import And, Filter, Not, Or, Phrase, Proximity, Query, Term, parse

# Weights of the ranking.
EXACT, PREFIX, NAME, SUBSTRING, PATH, TAG, EXTENSION, CONTENT, FUZZY, PHRASE, NEAR = 1000, 700, 500, 300, 250, 325, 350, 150, 100, 450, 375
APPLICATION, LOCATION, SCREENSHOT, PROJECT, RECENT, PINNED = 360, 260, 320, 300, 900, 650
_INTENTS = {
    "application": ("app", "apps", "application", "applications"), "downloads": ("download", "downloads"), "desktop": ("desktop",), "screenshot": ("screenshot", "screenshots", "capture"),
    "project": ("project", "projects", "repo", "repository", "workspace", "code"), "recent": ("recent", "recents", "recently", "today", "latest", "new"),
}
_PROJECT_PARENTS = ("developer", "development", "dev", "code", "projects", "repos", "workspace", "work")
_GENERIC = ("desktop", "documents", "downloads", "applications", "library", "users", "home", "work", "projects", "repos", "code", "src")



def _or(cols) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def _and(cols) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def _known(c: Column) -> Column:
    """Two-valued: null is false."""
    return F.coalesce(c, F.lit(False))


def _within(anchor: Column, others: list[Column], distance: int) -> Column:
    """An element of anchor has an element of each of the others within the distance."""
    return F.exists(anchor, lambda a: _and(F.exists(o, lambda b: F.abs(a - b) <= distance) for o in others))


class Compiler:
    """Columns over record_columns joined with p_0, p_1, …: the positions of the query's content terms."""

    def __init__(self, query: Query, deep: bool = True, fuzzy: bool = True, as_of: str | None = None):
        self.query, self.deep, self.fuzzy = query, deep, fuzzy
        self.now = F.unix_seconds(F.lit(as_of).cast("timestamp")) if as_of else F.unix_seconds(F.current_timestamp())
        self.place = {t: k for k, t in enumerate(query.content_terms)}

    # Predicates
    def contains(self, t: str) -> Column:
        hit = lambda c: F.contains(c, F.lit(t))
        return _known(hit(F.col("name_norm"))) | _known(hit(F.col("path_norm"))) | _known(F.exists("tags_norm", hit)) | _known(hit(F.col("comment_norm")))

    def positions(self, t: str) -> Column:
        return F.col(f"p_{self.place[t]}") if self.deep else F.lit(None).cast("array<int>")

    def in_content(self, t: str) -> Column:
        return self.positions(t).isNotNull()

    def is_fuzzy(self, t: str) -> Column:
        return _known(F.exists("name_tokens", lambda x: X.fuzzy_match(x, t))) if self.deep and self.fuzzy else F.lit(False)

    def phrase_in_content(self, phrase: str) -> Column:
        words = python_tokens(phrase)
        if not words or not self.deep:
            return F.lit(False)
        if len(words) == 1:
            return self.in_content(words[0])
        rest = [(k, self.positions(w)) for k, w in enumerate(words)][1:]
        return _known(F.exists(self.positions(words[0]), lambda at: _and(F.array_contains(p, at + k) for k, p in rest)))

    def phrase_in_record(self, phrase: str) -> Column:
        hit = lambda c: _known(F.contains(F.col(c), F.lit(phrase)))
        return hit("name_norm") | hit("path_norm") | hit("comment_norm")

    def phrase_seeds(self, phrase: str) -> Column:
        """Every word a whole token of one field, and the phrase in it."""
        words = python_tokens(phrase)
        field = lambda f: _and(F.array_contains(f"{f}_tokens", w) for w in words) & _known(F.contains(F.col(f"{f}_norm"), F.lit(phrase)))
        return (field("name") | field("path") | field("comment")) if words else F.lit(False)

    def near(self, p: Proximity) -> Column:
        """An occurrence of the term that is rarest in the document has each other term within the distance."""
        if not self.deep:
            return F.lit(False)
        held = [self.positions(t) for t in p.terms]
        anchors = F.array_sort(F.array(*(F.struct(F.size(h).alias("n"), F.lit(k).alias("k")) for k, h in enumerate(held))))
        found = F.lit(False)
        for k in range(len(held)):
            others = [h for j, h in enumerate(held) if j != k]
            ok = _within(held[k], others, p.distance)
            found = F.when(anchors[0]["k"] == k, ok).otherwise(found)
        return _known(_and(h.isNotNull() & (F.size(h) > 0) for h in held) & found)

    def filter(self, f: Filter) -> Column:
        if f.field in ("name", "path"):
            return _known(F.contains(F.col(f"{f.field}_norm"), F.lit(f.value)))
        if f.field == "ext":
            return _known(F.col("ext") == f.value)
        if f.field == "tag":
            return _known(F.array_contains("tags_norm", f.value))
        if f.field == "kind":
            return _known(F.col("kind") == f.value)
        if f.field == "scope":
            return self.scope(f.value)
        if f.field == "size":
            return _known({">": F.col("len") > f.low, ">=": F.col("len") >= f.low, "<": F.col("len") < f.low, "<=": F.col("len") <= f.low, "=": F.col("len") == f.low}[f.op])
        at = F.unix_seconds(f.field)
        tests = {">": at >= f.high, ">=": at >= f.low, "<": at < f.low, "<=": at < f.high, "=": (at >= f.low) & (at < f.high)}
        return _known(tests[f.op] & (at >= 0))

    def scope(self, value: str) -> Column:
        parts = F.split("path_norm", "/")
        has = lambda *names: _or(F.array_contains(parts, n) for n in names)
        if value in ("desktop", "documents", "downloads", "applications"):
            return _known(has(value))
        if value == "icloud":
            return _known(has("mobile documents", "icloud drive"))
        if value == "trash":
            return _known(has(".trash", "trash"))
        if value == "home":
            return _known(F.col("path_norm").rlike(r"(^|/)users/[^/]+"))
        root = value.rstrip("/")
        return _known((F.col("path_norm") == root) | F.startswith("path_norm", F.lit(root + "/")))

    def term(self, t: str) -> Column:
        return self.contains(t) | self.in_content(t) | self.is_fuzzy(t) | self.term_intent(t)

    def predicate(self, e=None) -> Column:
        q = self.query
        if e is None and q.expression is None:
            return (
                _and(~(self.contains(t) | self.in_content(t)) for t in q.excluded) & _and(self.phrase_in_record(p) | self.phrase_in_content(p) for p in q.phrases)
                & _and(self.near(p) for p in q.proximities) & _and(~self.filter(f) if negative else self.filter(f) for f, negative in q.filters)
            )
        e = q.expression if e is None else e
        if isinstance(e, Term):
            return self.term(e.text)
        if isinstance(e, Phrase):
            return self.phrase_in_record(e.text) | self.phrase_in_content(e.text)
        if isinstance(e, Proximity):
            return self.near(e)
        if isinstance(e, Filter):
            return self.filter(e)
        if isinstance(e, Not):
            return ~self.predicate(e.arm)
        return (_and if isinstance(e, And) else _or)(map(self.predicate, e.arms))

    # Intents
    def has_component(self, *names: str) -> Column:
        return F.arrays_overlap("path_tokens", F.array(*map(F.lit, names)))

    def intent_tests(self) -> dict[str, Column]:
        name = F.col("name_norm")
        age = self.now - F.unix_seconds("modified")
        recent = F.when(F.col("modified").isNull(), 0).when(age < 86_401, RECENT).when(age <= 7 * 86_400, 220).when(age <= 30 * 86_400, 150).otherwise(0)
        shot = name.contains("screenshot") | name.contains("screen shot") | (name.contains("screen") & name.contains("capture"))
        return {
            "application": F.when(_known(F.col("ext") == "app") | self.has_component("applications"), APPLICATION).otherwise(0), "downloads": F.when(self.has_component("downloads"), LOCATION).otherwise(0),
            "desktop": F.when(self.has_component("desktop"), LOCATION).otherwise(0), "screenshot": F.when(shot, F.when(self.has_component("desktop"), SCREENSHOT + 40).otherwise(SCREENSHOT)).otherwise(0),
            "project": F.when((F.col("kind") == "dir") & ~name.isin(*_GENERIC) & self.has_component(*_PROJECT_PARENTS), PROJECT).otherwise(0), "recent": recent,
        }

    def term_intent(self, t: str) -> Column:
        tests = self.intent_tests()
        return reduce(lambda a, k: a | (F.coalesce(tests[k], F.lit(0)) > 0), [k for k, words in _INTENTS.items() if t in words], F.lit(False))

    def intents(self) -> list[str]:
        q = self.query
        wanted = [k for k, words in _INTENTS.items() if any(w in q.terms or any(w in p for p in q.phrases) for w in words)]
        if "screenshot" not in wanted and ({"screen", "shot"} <= set(q.terms) or any("screen shot" in p for p in q.phrases)):
            wanted.append("screenshot")
        return wanted

    def intent_score(self) -> Column:
        wanted, tests = self.intents(), self.intent_tests()
        return reduce(lambda a, k: a + F.coalesce(tests[k], F.lit(0)), wanted, F.lit(0))

    # Signals: (test, weight, reason), in the order that decides ties of reasons
    def signals(self) -> list[tuple[Column, int, str]]:
        q, text, out = self.query, self.query.text, []
        if text:
            out.append((_known(F.col("name_norm") == text), EXACT, "ExactName"))
            if len(text) <= X.MAX_PREFIX:
                out.append((_known(F.exists("name_tokens", lambda t: F.startswith(t, F.lit(text)))), PREFIX, "PrefixName"))
        for t in q.terms:
            out += [(F.array_contains("name_tokens", t), NAME, "SubstringName"), (F.array_contains("path_tokens", t), PATH, "PathComponent"), (F.array_contains("comment_tokens", t), TAG, "Tag")]
            out += [(_known(F.col("ext") == t), EXTENSION, "Extension"), (F.array_contains("tags_norm", t), TAG, "Tag"), (self.in_content(t), CONTENT, "Content")]
        for t in q.terms:
            out.append((self.is_fuzzy(t) & self.shares_key(t) & ~self.contains(t), FUZZY, "FuzzyName"))
        for p in q.phrases:
            inside = self.phrase_in_content(p)
            out += [(inside, PHRASE, "Content"), (self.phrase_seeds(p) & ~inside, PHRASE, "PathComponent")]
        return out + [(self.near(p), NEAR, "Content") for p in q.proximities]

    def shares_key(self, t: str) -> Column:
        """Two terms of up to two characters meet on a deletion key only if they share a letter."""
        if not X.deletions(t):
            return F.lit(False)
        if len(t) > 2:
            return F.lit(True)
        return F.exists("name_tokens", lambda x: X.fuzzy_match(x, t) & ((F.length(x) > 2) | _or(F.contains(x, F.lit(c)) for c in t)))

    def boosts(self) -> Column:
        q = self.query
        days = F.floor((self.now - F.unix_seconds("modified")) / 86_400)
        total = F.when(F.col("modified").isNull() | (days < 0), 0).otherwise(100 - F.least(days, F.lit(100))) + self.intent_score()
        for f, negative in q.filters:
            kind = {"dir": 90, "file": 90, "link": 75, "other": 60}.get(f.value, 30) if f.field == "kind" and not negative else 30
            total = total + F.when(~self.filter(f) if negative else self.filter(f), kind).otherwise(0)
        for t in q.terms:
            total = total + 12 * X.count_term(F.col("name_norm"), t) + 6 * X.count_term(F.col("path_norm"), t)
            total = total + F.when(self.in_content(t), 8 * F.least(F.greatest(F.size(self.positions(t)), F.lit(1)), F.lit(8))).otherwise(0)
        return total

    # Candidates: None is unbounded
    def candidates(self, e) -> Column | None:
        if isinstance(e, Term):
            t = e.text
            return F.array_contains("name_tokens", t) | F.array_contains("path_tokens", t) | F.array_contains("comment_tokens", t) | _known(F.col("ext") == t) | F.array_contains("tags_norm", t) | self.in_content(t)
        if isinstance(e, Phrase):
            return self.phrase_seeds(e.text) | self.phrase_in_content(e.text)
        if isinstance(e, Proximity):
            return self.near(e) if self.deep else None
        if isinstance(e, Filter):
            if e.field in ("ext", "tag", "kind"):
                return self.filter(e)
            if e.field in ("name", "path") and python_tokens(e.value):
                return _and(F.array_contains(f"{e.field}_tokens", t) for t in python_tokens(e.value)) & self.filter(e)
            return None
        if isinstance(e, Not) or e is None:
            return None
        arms = [self.candidates(a) for a in e.arms]
        if isinstance(e, Or):
            return None if any(a is None for a in arms) else _or(arms)
        exact = [a for a, arm in zip(arms, e.arms, strict=True) if a is not None and not isinstance(arm, Term)]
        bounded = [a for a in arms if a is not None]
        return _and(exact) if exact else bounded[0] if bounded else None

    def everything(self) -> bool:
        """True if all records are candidates: an unbounded expression without a positive anchor."""
        e = self.query.expression
        return e is not None and self.candidates(e) is None and _needs_all(e)


def _anchored(e) -> bool:
    if isinstance(e, And):
        return any(map(_anchored, e.arms))
    if isinstance(e, Or):
        return bool(e.arms) and all(map(_anchored, e.arms))
    return isinstance(e, (Term, Phrase, Proximity))


def _needs_all(e) -> bool:
    if isinstance(e, And):
        return not _anchored(e) or all(map(_needs_all, e.arms))
    if isinstance(e, Or):
        return any(map(_needs_all, e.arms))
    return isinstance(e, (Filter, Not))


#: Candidates of at most so many ids (two numbers each) are broadcast to the records.
FEW = 200_000


class Lookup:
    """Candidates from a stored index: for each part of a query the keys of the postings that hold all its hits."""

    def __init__(self, index: Index, c: Compiler):
        self.index, self.c = index, c
        self.names: dict[str, set[str]] = {}
        self.words: set[str] = set()
        self.fuzzy: set[str] = set()

    def key(self, kind: str, *keys: str) -> None:
        self.names.setdefault(kind, set()).update(keys)

    def term(self, t: str) -> None:
        for kind in ("term", "path", "comment", "extension", "tag"):
            self.key(kind, t)
        if self.c.deep:
            self.words.add(t)
            if self.c.fuzzy:
                self.fuzzy.add(t)

    def rarest(self, kinds: tuple[str, ...], words: list[str]) -> str:
        """The word of the fewest postings of these kinds: each hit has them all, so the hits of one are enough."""
        if len(words) < 2:
            return words[0]
        rows = self.index.terms.filter(F.col("key").isin(words) & F.col("kind").isin(*kinds)).groupBy("key").agg(F.sum("df")).collect()  # a row a word of the query
        n = dict(map(tuple, rows))
        return min(words, key=lambda w: (n.get(w, 0), w))

    def anchored(self, words: list[str], kinds: tuple[str, ...]) -> None:
        if words:
            w = self.rarest(kinds, sorted(set(words)))
            for kind in kinds:
                if kind != "content":
                    self.key(kind, w)
                elif self.c.deep:
                    self.words.add(w)

    def seeds(self, e) -> bool:
        """The keys of an expression's bounded candidates; False where Compiler.candidates has none."""
        if isinstance(e, Term):
            self.term(e.text)
        elif isinstance(e, Phrase):
            self.anchored(python_tokens(e.text), ("term", "path", "comment", "content"))
        elif isinstance(e, Proximity):
            if not self.c.deep:
                return False
            self.anchored(list(e.terms), ("content",))
        elif isinstance(e, Filter):
            if e.field in ("ext", "tag", "kind"):
                self.key({"ext": "extension"}.get(e.field, e.field), e.value)
            elif e.field in ("name", "path") and python_tokens(e.value):
                self.anchored(python_tokens(e.value), ({"name": "term"}.get(e.field, e.field),))
            else:
                return False
        elif isinstance(e, Or):
            return all([self.seeds(a) for a in e.arms])
        elif isinstance(e, And):
            return any([self.seeds(a) for a in e.arms])
        else:
            return False
        return True

    def ids(self, substring: bool) -> DataFrame:
        """volume, node of all candidates."""
        q, x = self.c.query, self.index
        if q.text:
            self.key("exact", q.text)
            if len(q.text) <= X.MAX_PREFIX:
                self.key("prefix", q.text)
        for t in q.terms:
            self.term(t)
        for p in q.phrases:
            self.seeds(Phrase(p))
        for p in q.proximities:
            self.seeds(p)
        if q.expression is not None:
            self.seeds(q.expression)
        wanted = reduce(lambda a, k: a | ((F.col("kind") == k) & F.col("key").isin(sorted(self.names[k]))), sorted(self.names), F.lit(False))
        found = x.names.filter(wanted).select(*ID)
        if self.words and x.content is not None:
            found = found.unionByName(x.content.filter(F.col("term").isin(sorted(self.words))).select(*ID))
        keys = sorted({k for t in self.fuzzy for k in X.deletions(t)})
        if keys:
            near = x.fuzzy.filter(F.col("key").isin(keys)).select("term").distinct()
            near = near.filter(_or(X.fuzzy_match(F.col("term"), t) for t in sorted(self.fuzzy)))
            found = found.unionByName(x.names.filter("kind = 'term'").join(near, F.col("key") == F.col("term"), "left_semi").select(*ID))
        if substring:
            grams = sorted({q.text[k : k + 3] for k in range(len(q.text) - 2)})
            hits = x.names.filter((F.col("kind") == "gram") & F.col("key").isin(grams)).groupBy(*ID).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
            found = found.unionByName(hits.select(*ID))
        return found.distinct()


    def most(self, substring: bool) -> int | None:
        """At least as many as the candidates, from the counts of their postings; None if fuzzy names add to them."""
        if any(X.deletions(t) for t in self.fuzzy):
            return None
        asked = {k: sorted(keys) for k, keys in self.names.items()} | ({"content": sorted(self.words)} if self.words else {})
        if substring:  # a hit has all grams: any one of them bounds the hits
            asked["gram"] = [self.c.query.text[:3]]
        wanted = _or((F.col("kind") == k) & F.col("key").isin(keys) for k, keys in sorted(asked.items()))
        rows = self.index.terms.filter(F.col("key").isin(sorted({x for keys in asked.values() for x in keys})) & wanted)
        return rows.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]


def candidate_records(index: Index, c: Compiler, substring: bool) -> DataFrame:
    """The records that can be hits of the query: by the index, or all of them where it has nothing to say."""
    q = c.query
    only_filters = q.filters and not (q.terms or q.phrases or q.proximities)
    if c.intents() or c.everything() or only_filters and (q.expression is None or c.candidates(q.expression) is None):
        return index.columns
    lookup = Lookup(index, c)
    ids = lookup.ids(substring)
    most = lookup.most(substring)
    if most is None:
        ids = stored(ids, "candidates")
        most = ids.count()
    return index.columns.join(F.broadcast(ids) if most <= FEW else ids, ID, "left_semi")


def with_positions(columns: DataFrame, postings: DataFrame | None, terms: list[str]) -> DataFrame:
    """columns with p_k, the positions of term k in the record's content; null without the term."""
    if postings is None or not terms:
        return columns.withColumns({f"p_{k}": F.lit(None).cast("array<int>") for k in range(len(terms))})
    few = postings.filter(F.col("term").isin(terms))
    if len(terms) == 1:
        return columns.join(few.select(*ID, F.col("positions").alias("p_0")), ID, "left")
    each = few.groupBy(*ID).agg(*(F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p_{k}") for k, t in enumerate(terms)))
    return columns.join(each, ID, "left")


def ranked(columns: DataFrame | None, text: str, postings: DataFrame | None = None, limit: int = 50, deep: bool = True, fuzzy: bool = True, as_of: str | None = None, pinned: DataFrame | None = None, substring_fallback: str = "auto", volumes: list[int] | None = None, index: Index | None = None) -> DataFrame:
    """volume, node, path, name, score, reason of the best hits, in order; with an index, columns and postings are its own.

    substring_fallback: auto (only if fewer than limit records scored, as the language has it), always or never.
    """
    query = parse(text)
    columns, postings = (columns, postings) if index is None else (index.columns, index.content)
    none = columns.select(*ID, "path", "name", F.lit(0).cast("long").alias("score"), F.lit("").alias("reason")).limit(0)
    if limit <= 0 or query == Query() or volumes == []:
        return none
    if volumes is not None:
        columns = columns.filter(F.col("volume").isin(volumes))
    c = Compiler(query, deep, fuzzy, as_of)
    if index is not None:
        substring = len(query.text) >= 3 and substring_fallback != "never"
        columns = candidate_records(index, c, substring)
        columns = columns.filter(F.col("volume").isin(volumes)) if volumes is not None else columns
    rows = with_positions(columns, postings if deep else None, query.content_terms)
    signals = c.signals()
    flags = {f"s_{k}": test for k, (test, _, _) in enumerate(signals)}
    rows = rows.withColumns({**flags, "_boost": c.boosts(), "_intent": c.intent_score()})
    scored = _or(F.col(k) for k in flags)
    if len(query.text) >= 3 and substring_fallback != "never":
        if substring_fallback == "always" or rows.filter(scored).limit(limit).count() < limit:
            signals.append((None, SUBSTRING, "SubstringName"))
            rows = rows.withColumn(f"s_{len(flags)}", _known(F.contains("name_norm", F.lit(query.text))))
            scored = scored | F.col(f"s_{len(flags)}")
    bounded = c.candidates(query.expression) if query.expression is not None else None
    seeded = scored | (bounded if bounded is not None else F.lit(False)) | (F.col("_intent") > 0)
    only_filters = query.filters and not (query.terms or query.phrases or query.proximities)
    if c.everything() or (bounded is None and only_filters):
        seeded = F.lit(True)
    weights = F.array(*(F.struct(F.when(F.col(f"s_{k}"), w).otherwise(0).alias("w"), F.lit(-k).alias("o"), F.lit(r).alias("r")) for k, (_, w, r) in enumerate(signals)), F.struct(F.lit(0).alias("w"), F.lit(-999).alias("o"), F.lit("PathComponent").alias("r")))
    rows = rows.filter(seeded & c.predicate())
    if pinned is not None:
        rows = rows.join(pinned.select(*ID, F.lit(PINNED).alias("_pin")), ID, "left")
    else:
        rows = rows.withColumn("_pin", F.lit(0))
    best = F.array_max(F.filter(weights, lambda s: (s["w"] > 0) | (s["o"] == -999)))
    total = F.aggregate(weights, F.lit(0).cast("long"), lambda a, s: a + s["w"]) + F.col("_boost") + F.coalesce("_pin", F.lit(0))
    rows = rows.select(*ID, "path", "name", total.cast("long").alias("score"), best["r"].alias("reason"))
    return rows.orderBy(F.desc("score"), F.lower("name"), "path", *ID).limit(limit)


def hot_and_deep(columns: DataFrame | None, text: str, postings: DataFrame | None, **options) -> tuple[DataFrame, DataFrame]:
    """The hot batch (no content, no fuzzy names), and the deep batch: hits that are new or score higher than in it."""
    hot = ranked(columns, text, None, deep=False, **options)
    shown = hot.collect()  # the first page, at most limit rows: it is out before the deep pass starts
    before = {(r.volume, r.node): r.score for r in shown}
    deep = ranked(columns, text, postings, deep=True, **options)
    better = [r for r in deep.collect() if r.score > before.get((r.volume, r.node), r.score - 1)]
    spark = hot.sparkSession
    return spark.createDataFrame(shown, hot.schema), spark.createDataFrame(better, deep.schema)


def with_snippets(hits: DataFrame, content: DataFrame, text: str, context: int = 32) -> DataFrame:
    """hits with a snippet of the content where that is the reason."""
    query = parse(text)
    needles = F.array(*(F.lit(n) for n in [*query.phrases, *query.terms])).cast("array<string>")
    rows = hits.join(content.select(*ID, "text"), ID, "left")
    made = X.snippet(F.struct(F.col("text").alias("text"), needles.alias("needles"), F.lit(context).alias("context")))
    return rows.withColumn("snippet", F.when(F.col("reason") == "Content", made)).drop("text")
