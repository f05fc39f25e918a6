"""Title search: substring, fuzzy full text, re-ranked, cascade."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfgraph.functions.nodes import mentions
from shelfgraph.functions.text import contains_ci
from shelfgraph.functions.titles import analysed, levenshtein_similarity, search_tokens
from shelfgraph.graph import Graph, empty_like
from shelfgraph.operators.expand import expand, incident_edges
from shelfgraph.operators.filters import ENGLISH, JAPANESE, drop_content, title_matches
from shelfgraph.operators.limits import top_rows
from shelfgraph.operators.substrings import SubstringIndex, possible
from shelfgraph.session import spread

# Defaults (fixed values).
RANK_THRESHOLD = 0.45
MODES = ("ranked", "fulltext", "simple")
LANGUAGES = (JAPANESE, ENGLISH)
INDEXED = ("title_name", "english_name", "japanese_name", "title")
EXCLUDED = "hentai"
COLUMN_GAP = 1 << 16  # between the positions of two title columns

# BM25 parameters (Robertson et al.).
K1 = 1.2
B = 0.75


def by_members() -> list[Column]:
    """Most members first, then lowest numeric id; non-numeric ids last."""
    return [
        F.coalesce(F.col("members").try_cast("bigint"), F.lit(0)).desc(),
        F.col("work_id").try_cast("bigint").asc_nulls_last(),
        F.col("id").asc(),
    ]


TITLES = ("title_name", "english_name", "title", "work_id")


def by_title() -> list[Column]:
    title = F.coalesce(*TITLES, F.lit(""))
    return [F.lower(title).asc(), F.col("id").asc()]


def simple_hits(works: DataFrame, term: str | None, limit: int, language: str = ENGLISH, substrings: SubstringIndex | None = None) -> DataFrame:
    return top_rows(possible(works, term, substrings, "work").filter(title_matches(term, language)), limit, *by_members())


def query_terms(term: str | None) -> list[tuple[str, int]]:
    """Search tokens with the edits each allows, analysed as the titles are: only the last is fuzzy, by one edit, if it has two characters or more.

    Returns an empty list for no term, which matches everything. One edit would make a token of one character any other; Han and
    hiragana characters are tokens by themselves, so they are never fuzzy.
    """
    tokens = analysed(term)
    fuzzy = tokens[-1] if tokens and len(tokens[-1]) > 1 else None
    return [(t, int(t == fuzzy)) for t in dict.fromkeys(tokens)]


def term_edits(c) -> Column:
    """``query_terms`` for a column of terms, as an array of (token, edits)."""
    tokens = search_tokens(c)
    edits = lambda t: F.when((t == F.get(tokens, F.size(tokens) - 1)) & (F.length(t) > 1), 1).otherwise(0)
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("token"), edits(t).alias("edits")))


def _matches(token: Column, terms: list[tuple[str, int]]) -> Column:
    test = token.isin([w for w, _ in terms])
    for word, edits in terms:
        if edits:
            test = test | ((F.length(token) > 1) & (F.levenshtein(token, F.lit(word), edits) >= 0))
    return test


def _boost(token: Column, terms: list[tuple[str, int]]) -> Column:
    """1 for an exact word, less by edits over the shorter length for a near word; never 0, as near words have two characters or more."""
    fuzzy = next((w for w, edits in terms if edits), "")
    near = 1 - F.lit(1.0) / F.least(F.length(token), F.lit(max(2, len(fuzzy))))
    return F.when(token.isin([w for w, _ in terms]), F.lit(1.0)).otherwise(near)


def without_one(word: str) -> list[str]:
    """A word and all that is left of it without one character. Words at most one edit apart share one of these."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1:] for i in range(len(word) if len(word) > 1 else 0))]))


def _variants(token: Column) -> Column:
    """``without_one`` of a column."""
    places = F.when(F.length(token) > 1, F.sequence(F.lit(1), F.length(token))).otherwise(F.array().cast("array<int>"))
    left = F.transform(places, lambda i: F.concat(F.substring(token, F.lit(1), i - 1), F.substring(token, i + 1, F.length(token))))
    return F.array_distinct(F.concat(F.array(token), left))


@dataclass(frozen=True)
class TokenIndex:
    """Search tokens of works: ``postings(token, id, tf, positions, length, japanese)`` and one row ``totals(docs, tokens)``.

    Built from works it is lazy, and a search tokenises them. Written once, a search reads the files of its tokens: postings are sorted
    by token, and ``vocabulary(variant, token, df)``, sorted by variant, has each token under itself and under all that is left of it without
    one character, so that the tokens one edit from a word are found by equality.
    """

    postings: DataFrame
    totals: DataFrame
    vocabulary: DataFrame | None = None

    @staticmethod
    def of(works: DataFrame) -> TokenIndex:
        placed = lambda k: lambda t, i: F.struct(t.alias("token"), (i + k * COLUMN_GAP).alias("at"))
        tokens = F.concat(*[F.transform(search_tokens(c), placed(k)) for k, c in enumerate(INDEXED)])
        # Titles of one small file are dealt out: they are few bytes, and much work each.
        rows = spread(works.select("id", *INDEXED), "id").select("id", tokens.alias("_tokens"), (F.coalesce("japanese_name", F.lit("")) != "").alias("japanese"))
        # The explode keeps the tokens from being computed once for each use.
        rows = rows.select("id", "japanese", F.explode(F.array("_tokens")).alias("_tokens")).withColumn("length", F.size("_tokens"))
        places = lambda t: F.transform(F.filter("_tokens", lambda x: x["token"] == t), lambda x: x["at"])
        found = F.transform(F.array_distinct(F.transform("_tokens", lambda x: x["token"])), lambda t: F.struct(t.alias("token"), places(t).alias("positions")))
        postings = rows.select(F.explode(found).alias("t"), "id", "length", "japanese")
        postings = postings.select("t.token", "id", F.size("t.positions").alias("tf"), "t.positions", "length", "japanese")
        return TokenIndex(postings, rows.agg(F.count("*").alias("docs"), F.sum("length").alias("tokens")))

    def write(self, path: str) -> None:
        """Store the index; a common token's postings are dealt out by id too."""
        self.postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
        self.totals.write.mode("overwrite").parquet(f"{path}/totals")
        tokens = self.postings.sparkSession.read.parquet(f"{path}/postings").groupBy("token").agg(F.count("*").alias("df"))
        near = tokens.select(F.explode(_variants(F.col("token"))).alias("variant"), "token", "df")
        near.repartitionByRange("variant", "token").sortWithinPartitions("variant", "token").write.mode("overwrite").parquet(f"{path}/vocabulary")

    @staticmethod
    def read(spark, path: str) -> TokenIndex:
        return TokenIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "totals", "vocabulary")))

    def lookup(self, terms: list[tuple[str, int]]) -> DataFrame:
        """(token, df) of the stored tokens that match: equality with the variants of a word, then the distance of these few."""
        keys = sorted({v for word, edits in terms for v in (without_one(word) if edits else [word])})
        return self.vocabulary.filter(F.col("variant").isin(keys)).filter(_matches(F.col("token"), terms)).select("token", "df").distinct()

    def hits(self, terms: list[tuple[str, int]]) -> DataFrame:
        """Postings of the matching tokens with the number of works, ``df``, that have the token.

        With a vocabulary the tokens are known before the postings are planned (one small job; a word has few neighbours), so the scan is asked for these.
        Without one, the matching postings are dealt out by id once, for their frequencies and for the sums that follow.
        """
        if self.vocabulary is not None:
            known = [tuple(r) for r in self.lookup(terms).collect()]
            tokens = self.postings.sparkSession.createDataFrame(known, "token string, df long")
            return self.postings.filter(F.col("token").isin([t for t, _ in known])).join(tokens, "token")
        found = self.postings.filter(_matches(F.col("token"), terms)).repartition("id")
        return found.join(found.groupBy("token").agg(F.count("*").alias("df")), "token")


def phrase_ids(hits: DataFrame, tokens: list[str]) -> DataFrame:
    """Works that have the tokens one after another in one title column, in the order given."""
    offsets = F.lit(None)
    for t in dict.fromkeys(tokens):
        offsets = F.when(F.col("token") == t, F.array(*[F.lit(i) for i, x in enumerate(tokens) if x == t])).otherwise(offsets)
    starts = hits.withColumn("offset", F.explode(offsets)).select("id", F.explode("positions").alias("at"), "offset")
    whole = starts.groupBy("id", (F.col("at") - F.col("offset")).alias("start")).agg(F.count("*").alias("n")).filter(F.col("n") == len(tokens))
    return whole.select("id").distinct()


def token_scores(index: TokenIndex, terms: list[tuple[str, int]], language: str = ENGLISH, phrase: list[str] | None = None) -> DataFrame:
    """(id, score) by BM25 of the works with a matching token, or only of those with the ``phrase``. Frequencies count all works."""
    hits = index.hits(terms)
    rows = (hits.filter("japanese") if language == JAPANESE else hits).withColumn("_t", index.totals.select(F.struct("docs", "tokens")).scalar())
    idf = F.log(1 + (F.col("_t.docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.col("_t.tokens") / F.col("_t.docs")
    weight = _boost(F.col("token"), terms) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scores = rows.groupBy("id").agg(F.sum(weight).alias("score"))
    return scores.join(phrase_ids(hits, phrase), "id", "left_semi") if phrase else scores


def fulltext_scores(works: DataFrame, term: str | None, language: str = ENGLISH, index: TokenIndex | None = None, phrase: bool = False) -> DataFrame:
    """Works that match, with a BM25 ``score`` over their title columns; with no term, all of them with score 1.

    With ``phrase``, only works that have the term's tokens one after another, as written.
    """
    terms = query_terms(term)
    eligible = works if language != JAPANESE else works.filter(F.coalesce("japanese_name", F.lit("")) != "")
    if not terms:
        return eligible.withColumn("score", F.lit(1.0))
    return eligible.join(token_scores(index or TokenIndex.of(works), terms, language, analysed(term) if phrase else None), "id")


def _best_scores() -> list[Column]:
    return [F.round("score", 9).desc(), F.col("id").asc()]


def fulltext_hits(works: DataFrame, term: str | None, limit: int, language: str = ENGLISH, index: TokenIndex | None = None, phrase: bool = False) -> DataFrame:
    """The best ``limit`` works by full-text score, scores scaled to at most 1. Works are fetched for the ids left by the limit."""
    terms = query_terms(term)
    if not terms:
        return top_rows(fulltext_scores(works, term, language), limit, *_best_scores())
    best = top_rows(token_scores(index or TokenIndex.of(works), terms, language, analysed(term) if phrase else None), limit, *_best_scores())
    share = F.try_divide(F.col("score"), F.max("score").over(Window.partitionBy()))  # over these few rows
    return works.join(best.withColumn("score", share), "id")


def ranked_hits(works: DataFrame, term: str | None, limit: int, language: str = ENGLISH, candidates: int | None = None,
                threshold: float = RANK_THRESHOLD, index: TokenIndex | None = None) -> DataFrame:
    """Full-text hits re-ranked by half score, half title similarity: all hits, or the best ``candidates`` if a caller asks for that."""
    terms = query_terms(term)
    if terms:
        scores = token_scores(index or TokenIndex.of(works), terms, language)
        best = scores.select(F.max("score")).scalar()  # reads the same exchange as the rows do
        rows = works.join(scores if candidates is None else top_rows(scores, candidates, *_best_scores()), "id")
    else:
        rows, best = fulltext_scores(works, term, language), F.lit(1.0)
        rows = rows if candidates is None else top_rows(rows, candidates, *_best_scores())
    title = F.col("japanese_name") if language == JAPANESE else F.coalesce("title_name", "title", "english_name")
    similarity = levenshtein_similarity(F.lower(F.coalesce(title, F.lit(""))), F.lit((term or "").lower()))
    final = rows.withColumn("score", F.try_divide(F.col("score"), best)).withColumn("similarity", similarity).withColumn(
        "final_score", F.lit(0.5) * F.col("score") + F.lit(0.5) * F.col("similarity")
    )
    return top_rows(
        final.filter(F.col("final_score") >= threshold), limit, F.round("final_score", 9).desc(), F.col("id").asc()
    )


def hits_of(graph: Graph, term: str | None, limit: int, language: str, mode: str, index: TokenIndex | None = None,
            substrings: SubstringIndex | None = None) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    works = graph.of_type("work")
    if not term or mode == "simple":
        return simple_hits(works, term or None, limit, language, substrings)
    return (fulltext_hits if mode == "fulltext" else ranked_hits)(works, term, limit, language, index=index)


def _around(graph: Graph, hits: DataFrame, exclude: str | None) -> Graph:
    found = expand(graph, hits)
    return replace(drop_content(found, exclude), held=found.held) if exclude else found


def search(graph: Graph, term: str | None, limit: int = 50, language: str = ENGLISH, mode: str = "simple",
           exclude: str | None = EXCLUDED, index: TokenIndex | None = None, substrings: SubstringIndex | None = None) -> Graph:
    """Matching works with their neighbourhood; works of the excluded content leave after the limit."""
    return _around(graph, hits_of(graph, term, limit, language, mode, index, substrings), exclude)


def cascade(graph: Graph, term: str | None, limit: int = 3, languages=LANGUAGES, exclude: str | None = EXCLUDED, index: TokenIndex | None = None) -> Graph:
    """First non-empty search over languages, each by ranked, full text, then substring.

    A stage is asked for its few hits only; the neighbourhood is planned for the stage that answers, and what the others kept is freed.
    A stage whose hits are all excluded still answers if it leaves neighbours behind.
    """
    for language in languages:
        for mode in MODES:
            found = _around(graph, hits_of(graph, term, limit, language, mode, index), exclude)
            hits = found.held[0]
            if not hits.isEmpty() and (
                    not exclude or not hits.filter(~mentions(exclude, "genres", "genre")).isEmpty() or not found.nodes.isEmpty()):
                return found
            found.release()
    return empty_like(graph)


def name_search(graph: Graph, term: str, node_limit: int, edge_limit: int, substrings: SubstringIndex | None = None) -> Graph:
    """Nodes whose title or name contains the term, with a bounded number of their edges."""
    named = possible(graph.nodes, term, substrings).filter(contains_ci("title", term) | contains_ci("name", term) | contains_ci("title_name", term))
    hits = top_rows(named, node_limit, F.col("id")).persist()
    touching = top_rows(incident_edges(graph, hits), edge_limit, F.col("id"), F.col("end")).persist()
    ends = touching.select(F.col("other").alias("id")).distinct()
    others = graph.nodes_of(ends).join(hits.select("id"), "id", "left_anti")
    edges = touching.drop("other", "end").dropDuplicates(["id"]).withColumn("type", F.lower("type"))
    return Graph(hits.unionByName(others), edges, held=(hits, touching))


def text_search(works: DataFrame, credits: DataFrame, term: str, limit: int, substrings: SubstringIndex | None = None,
                names: SubstringIndex | None = None) -> DataFrame:
    """Works whose title, or one of whose creators, contains the term; best known first.

    ``credits(work_id, kind, name)`` is one row per creator, magazine or publisher of a work; an index of them has these columns too. With
    both indexes, credits and titles are read for candidates only.
    """
    by_creator = (
        possible(credits, term, names).filter((F.col("kind") == "creator") & contains_ci("name", term))
        .select(F.col("work_id").alias("id")).distinct().withColumn("_credited", F.lit(True))
    )
    if substrings is not None and names is not None:
        titled = possible(works, term, substrings, "work").filter(title_matches(term))
        credited = substrings.rows.matching(by_creator.select("id")).filter(F.col("type") == "work").join(titled.select("id"), "id", "left_anti")
        return top_rows(titled.unionByName(credited), limit, *by_members())
    hit = works.join(by_creator, "id", "left").filter(title_matches(term) | F.col("_credited"))
    return top_rows(hit.drop("_credited"), limit, *by_members())


def with_credits(hits: DataFrame, credits: DataFrame) -> DataFrame:
    """Rows of a limited result with their ``creators``, ``publishers`` and ``magazines`` as sorted lists, empty where there are none."""
    kinds = {"creators": "creator", "publishers": "publisher", "magazines": "magazine"}
    own = credits.join(hits.select(F.col("id").alias("work_id")), "work_id", "left_semi")
    lists = own.groupBy("work_id").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))).alias(name) for name, kind in kinds.items()])
    none = F.array().cast("array<string>")
    joined = hits.join(lists.withColumnRenamed("work_id", "id"), "id", "left")
    return joined.withColumns({name: F.coalesce(name, none) for name in kinds})
