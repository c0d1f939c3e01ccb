"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``, each over whole tables.

Hold-out batches come from the library's own systematic split, so both the
catalog and the query batch grow with the tables. An LSH index is written once
per query before it is searched, as a user would keep it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinara.functions import bands as B
from affinara.functions import similarity as S
from affinara.functions import text as X
from affinara.functions import vectors as V
from affinara.operators import catalog as C
from affinara.operators import evaluate as E
from affinara.operators import features as Fe
from affinara.operators import lsh as L
from affinara.operators import lsh_store as Ls
from affinara.operators import predict as P
from affinara.operators import profile as Pr
from affinara.operators import ranking as R
from affinara.operators import sketches as Sk
from affinara.plans import standin
from affinara.shipping import scratch_path, written
from affinara.sources import predictions as Sp
from affinara.sources import tables as St

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# The stand-in's kinds in place of movie, tvMovie and tvSpecial.
KINDS = ["ECONOMY", "SMALL", "STANDARD"]
VECTOR_ORDER = ("rating", "id")
# What feature vectors are built from.
FEATURE_COLUMNS = ["id", "title", "rating", "votes", "kind", "flag", "runtime", "genres", "directors"]
# Size rule tight enough that some queries fall back to their smallest bucket.
TIGHT_SHARE = 0.02


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *names: str, scale: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name), scale) for name in names})


# --- catalog ---


@query
def catalog_join(spark, sf):
    """Ratings x basics x crew on the id, lists back to comma text."""
    basics = standin.table(spark, sf, "part").select(
        F.col("p_partkey").alias("tconst"),
        F.col("p_type").alias("titleType"),
        F.col("p_name").alias("originalTitle"),
        (F.col("p_size") % 2).alias("isAdult"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("runtimeMinutes"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(",")).alias("genres"),
    )
    made = standin.lists_per_part(spark, sf).withColumnRenamed("l_partkey", "tconst")
    ratings = made.select("tconst", F.col("rating").alias("averageRating"), F.col("votes").alias("numVotes"))
    crew = made.select("tconst", "directors", "writers")
    joined = C.build_catalog(ratings, basics, crew)
    return joined.withColumns({name: X.join_list(F.col(name)) for name in C.LISTS})


@query
def list_split_join(spark, sf):
    """Comma text split, exploded, counted and joined again; trailing empty items are dropped."""
    texts = standin.title_rows(spark, sf).select("id", F.concat("directors", F.lit(",,")).alias("text"))
    split = texts.withColumn("items", X.split_list(F.col("text")))
    return split.select("id", F.size("items").cast("long").alias("n_items"), X.join_list(F.col("items")).alias("joined"))


@query
def kind_filter(spark, sf):
    """Kept kinds: titles and flagged titles per kind."""
    kept = C.only_kinds(standin.catalog(spark, sf), *KINDS)
    return kept.groupBy("kind").agg(
        F.count(F.lit(1)).alias("titles"), F.count_if(F.col("flag") == 1).alias("flagged")
    )


@query
def flagged_count(spark, sf):
    return Pr.flagged_count(standin.catalog(spark, sf))


@query
def semi_lookup(spark, sf):
    """Catalog rows whose id is among the parts of returned lines."""
    wanted = (
        standin.table(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("id"))
    )
    return C.rows_with_ids(standin.catalog(spark, sf), wanted).select("id", "title", "rating", "votes")


# --- attribute similarity ---


def successive_titles(spark, sf) -> DataFrame:
    """Each title in one row with the next one in vote order."""
    names = ["id", "flag", "runtime", "genres", "writers", "directors"]
    numbered = R.global_row_number(standin.catalog(spark, sf).select("votes", *names), ["votes", "id"], "nth")
    a = numbered.select("nth", *[F.col(n).alias(f"a_{n}") for n in names])
    b = numbered.select((F.col("nth") - 1).alias("nth"), *[F.col(n).alias(f"b_{n}") for n in names])
    return a.join(b, "nth")


def attribute_similarity(spark, sf, overlap: str) -> DataFrame:
    pairs = successive_titles(spark, sf)
    a, b = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    out = pairs.select(
        F.col("a_id").alias("id"),
        F.col("b_id").alias("other"),
        S.flag_similarity(a("flag"), b("flag")).alias("flag_sim"),
        S.runtime_similarity(a("runtime"), b("runtime")).alias("runtime_sim"),
        S.list_overlap(a("genres"), b("genres"), overlap).alias("genre_sim"),
        S.list_overlap(a("writers"), b("writers"), overlap).alias("writer_sim"),
        S.list_overlap(a("directors"), b("directors"), overlap).alias("director_sim"),
        S.attribute_score(a, b, overlap=overlap).alias("score"),
    )
    return rounded(out, "runtime_sim", "genre_sim", "writer_sim", "director_sim", "score")


@query
def attribute_similarity_exact(spark, sf):
    return attribute_similarity(spark, sf, "exact")


@query
def attribute_similarity_ratio(spark, sf):
    return attribute_similarity(spark, sf, "ratio")


def hold_out_titles(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The whole catalog, and its hold-out as a query batch."""
    needed = standin.catalog(spark, sf).select("id", "kind", *P.ATTRIBUTES, "rating", "votes")
    titles = R.global_row_number(needed, ["votes", "id"], "nth")
    return titles, standin.as_batch(titles.filter(R.is_test(F.col("nth"))))


@query
def attribute_top50(spark, sf):
    catalog, batch = hold_out_titles(spark, sf)
    return P.attribute_neighbours(catalog, batch).select("qid", "id", "rank", "score")


@query
def attribute_top50_exact(spark, sf):
    catalog, batch = hold_out_titles(spark, sf)
    found = P.attribute_neighbours(catalog, batch, overlap="exact", kinds=KINDS)
    return found.select("qid", "id", "rank", "score")


@query
def attribute_predict(spark, sf):
    """Predicted rating, also in its three-character text form."""
    catalog, batch = hold_out_titles(spark, sf)
    out = rounded(P.attribute_predict(catalog, batch), "predicted")
    return out.withColumn("shown", X.cut_text(F.col("predicted")))


def hard_titles(spark, sf) -> tuple[DataFrame, DataFrame]:
    needed = standin.hard_catalog(spark, sf).select("id", "kind", *P.ATTRIBUTES, "rating", "votes")
    titles = R.global_row_number(needed, ["votes", "id"], "nth")
    return titles, titles.filter(R.is_test(F.col("nth")))


@query
def attribute_similarity_hard(spark, sf):
    """Null titles, null lists and repeated items: each title with the next one in vote order."""
    titles, _ = hard_titles(spark, sf)
    names = ["id", "flag", "runtime", "genres", "writers", "directors"]
    a = titles.select("nth", *[F.col(n).alias(f"a_{n}") for n in names])
    b = titles.select((F.col("nth") - 1).alias("nth"), *[F.col(n).alias(f"b_{n}") for n in names])
    one, other = (lambda n: F.col(f"a_{n}")), (lambda n: F.col(f"b_{n}"))
    out = a.join(b, "nth").select(
        F.col("a_id").alias("id"),
        F.col("b_id").alias("other"),
        S.list_overlap(one("genres"), other("genres")).alias("genre_sim"),
        S.attribute_score(one, other).alias("score"),
    )
    return rounded(out, "genre_sim", "score")


@query
def attribute_top50_hard(spark, sf):
    titles, test = hard_titles(spark, sf)
    return P.attribute_neighbours(titles, standin.as_batch(test)).select("qid", "id", "rank", "score")


# --- features and split ---


@query
def runtime_centred(spark, sf):
    out = Fe.centred_runtime(standin.stored_catalog(spark, sf, "id", "runtime")).select("id", "runtime", "avg_runtime")
    return rounded(out.withColumn("filled", F.coalesce("avg_runtime", F.lit(0.0))), "avg_runtime", "filled")


@query
def kind_onehot(spark, sf):
    flags = Fe.kind_flags(F.col("kind"), KINDS)
    return standin.catalog(spark, sf).select("id", "kind", *[flag.alias(name.lower()) for name, flag in flags.items()])


@query
def tag_multihot(spark, sf):
    """Genre flags in long form, zeros included."""
    catalog = standin.stored_catalog(spark, sf, "id", "genres")
    words = Fe.distinct_vocabulary(catalog, "genres")
    length = words.select(F.count(F.lit(1))).scalar()
    rows = catalog.select("id").join(Fe.hot_positions(catalog, "genres", words), "id", "left").withColumn("length", length)
    cells = rows.filter("length > 0").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)))
    held = F.coalesce(F.array_contains("hot", F.col("pos")), F.lit(False))
    return cells.select("id", "pos", held.cast("int").cast("double").alias("value"))


def maker_flags(spark, sf, **options) -> DataFrame:
    catalog = standin.stored_catalog(spark, sf, "id", "directors")
    words = Fe.top_vocabulary(catalog, "directors", Fe.TOP_DIRECTORS, **options)
    hot = Fe.hot_positions(catalog, "directors", words)
    return hot.select("id", F.explode("hot").alias("pos")).withColumn("value", F.lit(1.0))


@query
def maker_top_multihot(spark, sf):
    """Director flags in long form: the titles' directors that are among the most frequent 500."""
    return maker_flags(spark, sf)


@query
def maker_top_multihot_compat(spark, sf):
    """As above, but leaving out the first rank instead of the missing mark."""
    return maker_flags(spark, sf, exclude=(), skip=1)


@query
def vocabulary(spark, sf):
    _, names = Fe.build_features(standin.stored_catalog(spark, sf, *FEATURE_COLUMNS), KINDS)
    return names


@query
def feature_vector(spark, sf):
    """The vectors' non-zero positions and their length."""
    features, _ = Fe.build_features(standin.stored_catalog(spark, sf, *FEATURE_COLUMNS), KINDS)
    cells = features.select(
        "id",
        F.col("vector.size").alias("length"),
        F.explode(F.arrays_zip("vector.indices", "vector.values")).alias("e"),
    )
    out = cells.select("id", "length", F.col("e.indices").alias("pos"), F.col("e.values").alias("value"))
    return rounded(out, "value")


@query
def global_rank(spark, sf):
    return R.global_row_number(standin.catalog(spark, sf).select("id", "votes"), ["votes", "id"], "nth")


@query
def split_train(spark, sf):
    train, _ = R.systematic_split(standin.catalog(spark, sf).select("id", "votes", "rating"))
    return train


@query
def split_test(spark, sf):
    _, test = R.systematic_split(standin.catalog(spark, sf).select("id", "votes", "rating"))
    return test


@query
def limit_rows(spark, sf):
    """The first ten hold-out titles by id."""
    _, test = R.systematic_split(standin.catalog(spark, sf).select("id", "votes"))
    return test.orderBy("id").limit(10)


# --- vectors ---


def successive_vectors(spark, sf) -> DataFrame:
    """Each vector in one row with the next one in (label, id) order."""
    numbered = R.global_row_number(standin.vectors(spark, sf), VECTOR_ORDER, "nth")
    a = numbered.select("nth", "id", F.col("vector").alias("a"))
    b = numbered.select((F.col("nth") - 1).alias("nth"), F.col("id").alias("other"), F.col("vector").alias("b"))
    return a.join(b, "nth")


@query
def dot_pairs(spark, sf):
    out = successive_vectors(spark, sf).select("id", "other", V.dot(F.col("a"), F.col("b")).alias("dot"))
    return rounded(out, "dot")


@query
def cosine_pairs(spark, sf):
    a, b = F.col("a"), F.col("b")
    out = successive_vectors(spark, sf).select(
        "id", "other", V.magnitude(a).alias("magnitude"), V.cosine(a, b).alias("cosine")
    )
    return rounded(out, "magnitude", "cosine")


def hold_out_vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    train, test = R.systematic_split(standin.vectors(spark, sf), VECTOR_ORDER)
    return train, standin.as_batch(test)


@query
def cosine_top10(spark, sf):
    train, batch = hold_out_vectors(spark, sf)
    return P.cosine_neighbours(train, batch).select("qid", "id", "rank", "score")


@query
def cosine_top10_blocks(spark, sf):
    """The same through the grid of blocks that large query batches take."""
    train, batch = hold_out_vectors(spark, sf)
    found = P.cosine_neighbours(train, batch, catalog_block=512, query_block=128)
    return found.select("qid", "id", "rank", "score")


@query
def cosine_predict(spark, sf):
    train, batch = hold_out_vectors(spark, sf)
    return rounded(P.cosine_predict(train, batch), "predicted")


@query
def cosine_predict_features(spark, sf):
    """Whole pipeline: catalog, feature vectors, split, exact cosine prediction."""
    features, _ = Fe.build_features(standin.stored_catalog(spark, sf, *FEATURE_COLUMNS), KINDS)
    train, test = R.systematic_split(written(features, "features"))
    return rounded(P.cosine_predict(train, standin.as_batch(test), form="classes"), "predicted")


@query
def cosine_top10_pruned(spark, sf):
    """Feature vectors' exact neighbours through the inverted index with block bounds."""
    features, _ = Fe.build_features(standin.stored_catalog(spark, sf, *FEATURE_COLUMNS), KINDS)
    train, test = R.systematic_split(written(features, "features"))
    found = P.cosine_neighbours(train, standin.as_batch(test), form="pruned", block_rows=256)
    return found.select("qid", "id", "rank", "score")


@query
def cosine_hard(spark, sf):
    """With zero vectors in catalog and batch: these have no cosine, so such a query gets a null prediction."""
    train, test = R.systematic_split(standin.hard_vectors(spark, sf), VECTOR_ORDER)
    return rounded(P.cosine_predict(train, standin.as_batch(test)), "predicted")


# --- LSH ---


@query
def lsh_predict_features(spark, sf):
    """Whole pipeline: catalog, feature vectors, split, LSH prediction."""
    features, _ = Fe.build_features(standin.stored_catalog(spark, sf, *FEATURE_COLUMNS), KINDS)
    train, test = R.systematic_split(written(features, "features"))
    index = written(L.lsh_index(train), "index")
    return L.lsh_predict(index, written(L.lsh_index(standin.as_batch(test), id_name="qid"), "batch"), form="classes")


def indexed(spark, sf, planes: int = 25, bands: int = 5) -> tuple[DataFrame, DataFrame]:
    """Written index of the training vectors, and the hold-out batch with its bucket keys."""
    train, batch = hold_out_vectors(spark, sf)
    index = written(L.lsh_index(train, planes, bands), "index")
    return index, written(L.lsh_index(batch, planes, bands, id_name="qid"), "batch")


@query
def lsh_candidates_fine(spark, sf):
    """Twelve planes per band, for larger catalogs: far fewer unrelated titles share a bucket."""
    return L.lsh_candidates(*indexed(spark, sf, 60, 5))


@query
def lsh_predict_fine(spark, sf):
    return L.lsh_predict(*indexed(spark, sf, 60, 5))


@query
def lsh_no_hit(spark, sf):
    """So many planes per band that many queries hit no bucket: they get a null prediction."""
    return L.lsh_predict(*indexed(spark, sf, 60, 3))


@query
def lsh_recall(spark, sf):
    """Share of the exact ten nearest that LSH finds, for the coarse and the fine setting."""
    train, batch = hold_out_vectors(spark, sf)
    exact = written(P.cosine_neighbours(train, batch).select("qid", "id"), "exact")
    total = exact.select(F.count(F.lit(1))).scalar()
    out = None
    for planes in (25, 60):
        found = L.lsh_neighbours(*indexed(spark, sf, planes, 5)).select("qid", "id").join(exact, ["qid", "id"])
        row = found.agg(F.count(F.lit(1)).alias("hits")).select(
            F.lit(planes).alias("planes"), F.lit(5).alias("bands"), F.round(F.col("hits") / total, 6).alias("recall")
        )
        out = row if out is None else out.unionByName(row)
    return out


# Planes, bands and probes of the searches within a budget; shares of all titles that a query may look at.
PROBED = {"planes": 50, "bands": 5}
PROBES = 2000
BUDGETS = (0.05, 0.2, 0.6)


def probed(spark, sf) -> tuple[DataFrame, DataFrame]:
    index, batch = indexed(spark, sf, **PROBED)
    return index, written(L.with_probes(batch, **PROBED, most=PROBES), "probes")


@query
def lsh_probe_candidates(spark, sf):
    """Candidates from the nearest buckets of all bands, at most one in twenty of all titles."""
    index, batch = probed(spark, sf)
    return L.lsh_candidates(index, batch, budget=BUDGETS[0])


@query
def lsh_probe_recall(spark, sf):
    """Share of the exact ten nearest found within each budget, and the share of all pairs that were looked at."""
    train, batch = hold_out_vectors(spark, sf)
    exact = written(P.cosine_neighbours(train, batch).select("qid", "id"), "exact")
    index, looks = probed(spark, sf)
    nearest = exact.groupBy("qid").agg(F.collect_list("id").alias("nearest"))
    looks = written(looks.join(nearest, "qid", "left"), "marked")
    sizes = written(L.bucket_sizes(index), "sizes")
    total = exact.select(F.count(F.lit(1))).scalar()
    pairs = index.select(F.count(F.lit(1))).scalar() * looks.select(F.count(F.lit(1))).scalar()
    out = None
    for budget in BUDGETS:
        # hits are marked and pairs counted where a pair is met: they never become rows
        met = L.lsh_candidates(index, looks, sizes=sizes, budget=budget, marks="nearest", counts=True)
        row = met.agg(F.sum("hits").alias("hits"), F.sum("met").alias("met")).select(
            F.lit(budget).alias("budget"),
            F.round(F.col("hits") / total, 6).alias("recall"),
            F.round(F.col("met") / pairs, 6).alias("pair_share"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def stored_index(spark, sf) -> tuple[str, DataFrame]:
    """An index on disk: three quarters of the training vectors first, the others appended; and the hold-out."""
    train, batch = hold_out_vectors(spark, sf)
    path = scratch_path(spark, "lsh-store")
    Ls.create(train.filter(F.col("id") % 4 != 3), path, files=8)
    Ls.append(train.filter(F.col("id") % 4 == 3), path)
    return path, batch


@query
def lsh_store_predict(spark, sf):
    """From an index in two generations: the predictions of an index built at once."""
    path, batch = stored_index(spark, sf)
    return Ls.predict(batch, path)


@query
def lsh_store_compacted(spark, sf):
    """The neighbours after compaction."""
    path, batch = stored_index(spark, sf)
    Ls.compact(spark, path)
    return Ls.neighbours(batch, path).select("qid", "id", "rank", "score")


@query
def lsh_signature(spark, sf):
    index = L.lsh_index(standin.vectors(spark, sf), keep_signature=True)
    return index.select("id", B.band_text(F.col("signature")).alias("signature"))


@query
def lsh_buckets(spark, sf):
    """Bucket sizes per band, with the bucket's least and greatest member."""
    members = L.bucket_members(L.lsh_index(standin.vectors(spark, sf)))
    return members.groupBy("band", "band_key").agg(
        F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def band_rows(spark, sf) -> DataFrame:
    index = L.lsh_index(standin.vectors(spark, sf), keep_signature=True)
    return index.select("id", F.posexplode(B.split_bands(F.col("signature"), 25, 5)).alias("band", "signs"))


@query
def band_key_mod(spark, sf):
    return band_rows(spark, sf).select("id", "band", B.band_key_mod(F.col("signs")).alias("band_key"))


@query
def band_key_sha256(spark, sf):
    return band_rows(spark, sf).select("id", "band", B.band_key_sha256(F.col("signs")).alias("band_key"))


@query
def band_key_text(spark, sf):
    return band_rows(spark, sf).select("id", "band", B.band_text(F.col("signs")).alias("band_key"))


@query
def lsh_candidates(spark, sf):
    index, batch = indexed(spark, sf)
    return L.lsh_candidates(index, batch)


@query
def lsh_candidates_blocks(spark, sf):
    """The same through the grid of blocks that large query batches take."""
    index, batch = indexed(spark, sf)
    return L.lsh_candidates(index, batch, catalog_block=512, query_block=128)


@query
def lsh_candidates_tight(spark, sf):
    """A size rule so tight that some queries fall back to their smallest bucket."""
    index, batch = indexed(spark, sf)
    return L.lsh_candidates(index, batch, max_share=TIGHT_SHARE)


@query
def lsh_top10(spark, sf):
    index, batch = indexed(spark, sf)
    return L.lsh_neighbours(index, batch).select("qid", "id", "rank", "score")


@query
def lsh_predict(spark, sf):
    index, batch = indexed(spark, sf)
    return L.lsh_predict(index, batch)


@query
def lsh_predict_blocks(spark, sf):
    """The same through the grid of blocks that large query batches take."""
    index, batch = indexed(spark, sf)
    return L.lsh_predict(index, batch, catalog_block=512, query_block=128)


@query
def lsh_predict_compat(spark, sf):
    """Neighbours by descending id, sum over ten."""
    index, batch = indexed(spark, sf)
    return L.lsh_predict(index, batch, neighbour_order="id_desc", denominator="k")


# --- evaluation ---


def lsh_predictions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Predictions of the hold-out by LSH, stored, and the hold-out's true ratings."""
    train, test = R.systematic_split(standin.vectors(spark, sf), VECTOR_ORDER)
    index = written(L.lsh_index(train), "index")
    batch = written(L.lsh_index(standin.as_batch(test), id_name="qid"), "batch")
    return written(L.lsh_predict(index, batch), "predicted"), test.select("id", "rating")


def predicted_pairs(spark, sf) -> DataFrame:
    return E.with_actual(*lsh_predictions(spark, sf))


@query
def rmse_mse(spark, sf):
    return rounded(E.errors(predicted_pairs(spark, sf)), "mse", "rmse")


@query
def confusion_matrix(spark, sf):
    return E.confusion_matrix(predicted_pairs(spark, sf))


@query
def half_even_rounding(spark, sf):
    """Half-even and half-up rounding of half steps."""
    half = F.col("p_size") / 2
    return standin.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        X.round_half_even(half).alias("half_even"),
        X.round_half_up(half / 10).alias("half_up"),
    )


@query
def evaluate_saved_lines(spark, sf):
    """Predictions written as text lines, parsed again and compared with the true ratings."""
    predicted, test = lsh_predictions(spark, sf)
    path = scratch_path(spark, "lines")
    Sp.write_lines(predicted.select(Sp.line_text(F.col("qid"), F.col("predicted"))), path)
    parsed = Sp.read_lines(spark, path).select(F.col("id").cast("long").alias("qid"), "predicted")
    return rounded(E.errors(E.with_actual(parsed, test)), "mse", "rmse")


@query
def prediction_report(spark, sf):
    """Report lines with the true and the predicted rating."""
    pairs = predicted_pairs(spark, sf)
    return Sp.report(rounded(pairs, "predicted"))


def timed_predictions(spark, sf) -> DataFrame:
    return standin.table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        (F.col("p_size") / 5).alias("predicted"),
        F.round(F.col("p_retailprice") / 200, 3).alias("seconds"),
    )


def predictions_on_disk(spark, sf, layout: str) -> str:
    """The predictions written as text in one of the two layouts; returns the folder."""
    rows, path = timed_predictions(spark, sf), scratch_path(spark, layout)
    if layout == "lines":
        Sp.write_lines(rows.select(Sp.line_text(F.col("id"), F.col("predicted"))), path)
    else:
        Sp.write_tuples(rows.select(Sp.tuple_text(F.col("id"), F.col("predicted"), F.col("seconds"))), path)
    return path


@query
def parse_lines(spark, sf):
    return Sp.read_lines(spark, predictions_on_disk(spark, sf, "lines"))


@query
def parse_tuples(spark, sf):
    return Sp.read_tuples(spark, predictions_on_disk(spark, sf, "tuples"))


@query
def mean_seconds(spark, sf):
    timed = Sp.read_tuples(spark, predictions_on_disk(spark, sf, "tuples"))
    return rounded(E.mean_seconds(timed), "mean_seconds")


# --- profile ---


@query
def column_summary(spark, sf):
    out = Pr.column_summary(standin.stored_catalog(spark, sf, *Pr.NUMBERS))
    return rounded(out, "mean", "max", "min", "std", "q1", "q2", "q3")


@query
def distinct_counts(spark, sf):
    return Pr.distinct_counts(standin.catalog(spark, sf))


@query
def histogram10(spark, sf):
    return rounded(Pr.histogram(standin.stored_catalog(spark, sf, "rating"), "rating"), "low", "high")


@query
def histogram10_test(spark, sf):
    _, test = R.systematic_split(standin.catalog(spark, sf).select("id", "votes", "rating"))
    return rounded(Pr.histogram(test, "rating"), "low", "high")


@query
def token_frequency(spark, sf):
    return Pr.token_frequency(standin.catalog(spark, sf), "genres")


@query
def top20_makers(spark, sf):
    return Pr.most_frequent(standin.catalog(spark, sf), "directors", 20)


@query
def raw_maker_ranks(spark, sf):
    return Pr.raw_list_ranks(standin.catalog(spark, sf), "directors")


def sketches_of_batches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The catalog, and its sketches from three batches stored one after the other."""
    rows = standin.stored_catalog(spark, sf, "id", *Pr.NUMBERS, *C.LISTS)
    path, batches = scratch_path(spark, "sketches"), ["first", "second", "third"]
    for i, batch in enumerate(batches):
        Sk.store(rows.filter(F.pmod("id", F.lit(3)) == i), path, batch)
    return rows, Sk.stored(spark, path, batches)


@query
def distinct_sketch(spark, sf):
    """Exact distinct counts, and whether the merged sketches' estimates keep their stated error."""
    rows, kept = sketches_of_batches(spark, sf)
    near = Sk.distinct_estimates(kept).withColumnRenamed("n_distinct", "estimate")
    both = Pr.distinct_counts(rows).join(near, "list")
    within = F.abs(F.col("estimate") - F.col("n_distinct")) <= F.col("n_distinct") * Sk.DISTINCT_ERROR
    return both.select("list", "n_distinct", within.alias("within"))


@query
def quantile_sketch(spark, sf):
    """Whether the ranks of the merged sketches' quartiles keep their stated error."""
    rows, kept = sketches_of_batches(spark, sf)
    near = Sk.quantile_estimates(kept).withColumnRenamed("value", "estimate")
    values = R.value_counts(rows, Pr.NUMBERS).join(F.broadcast(near), "column")  # three rows a column
    value, estimate, n = F.col("value"), F.col("estimate"), F.col("n")
    below, upto = F.sum(F.when(value < estimate, n).otherwise(0)), F.sum(F.when(value <= estimate, n).otherwise(0))
    ranks = values.groupBy("column", "share").agg((below / F.sum(n)).alias("below"), (upto / F.sum(n)).alias("upto"))
    within = (F.col("below") <= F.col("share") + Sk.RANK_ERROR) & (F.col("upto") >= F.col("share") - Sk.RANK_ERROR)
    return ranks.select("column", "share", within.alias("within"))


@query
def array_report(spark, sf):
    """True and predicted ratings as two one-line ``Array(...)`` files in the order of ids; how often each holds a value."""
    path = scratch_path(spark, "arrays")
    Sp.write_array_report(rounded(predicted_pairs(spark, sf), "predicted"), path)
    lists = [Sp.read_array(spark, f"{path}/{name}.txt").withColumn("list", F.lit(name)) for name in ("actual", "predicted")]
    return lists[0].unionByName(lists[1]).groupBy("list", "value").agg(F.count(F.lit(1)).alias("n"))


# --- text tables ---


@query
def tsv_roundtrip(spark, sf):
    """Catalog written as tab-separated text and read back with its declared schema."""
    path = scratch_path(spark, "titles")
    St.write_tsv(St.titles_out(standin.catalog(spark, sf)), path)
    back = C.as_catalog(St.read_titles(spark, path))
    return back.withColumns({name: X.join_list(F.col(name)) for name in C.LISTS})


@query
def tsv_one_file(spark, sf):
    """Catalog written as one tab-separated file by many tasks, in the order of its ids, and read back."""
    path = scratch_path(spark, "titles")
    St.write_tsv(St.titles_out(standin.catalog(spark, sf)), path, single_file=True, order=["tconst"])
    back = C.as_catalog(St.read_titles(spark, path))
    return back.withColumns({name: X.join_list(F.col(name)) for name in C.LISTS})


def title_files(spark, sf) -> dict[str, str]:
    """The part and lineitem tables as the text files a user starts from: basics, crew, ratings and query titles."""
    rows = standin.title_rows(spark, sf)
    tid = F.concat(F.lit("tt"), F.col("id").cast("string")).alias("tconst")
    kind = F.when(F.col("kind").startswith("ECONOMY"), "movie").when(F.col("kind").startswith("SMALL"), "tvMovie").otherwise("short")
    none = F.lit(X.MISSING)
    shown = lambda c: F.coalesce(F.col(c).cast("string"), none)
    basics = rows.select(
        tid, kind.alias("titleType"), F.lit("x").alias("primaryTitle"), F.col("title").alias("originalTitle"), F.col("flag").alias("isAdult"),
        F.lit(2000).alias("startYear"), none.alias("endYear"), shown("runtime").alias("runtimeMinutes"), "genres",
    )
    titles = rows.filter(F.col("kind").startswith("ECONOMY"))
    parts = {
        "basics": basics,
        "crew": rows.select(tid, "directors", "writers"),
        "ratings": rows.select(tid, F.col("rating").alias("averageRating"), F.col("votes").alias("numVotes")),
        "queries": titles.select(
            F.col("rating").cast("string").alias("averageRating"), F.lit("movie").alias("titleType"), F.col("title").alias("originalTitle"),
            F.col("flag").alias("isAdult"), shown("runtime").alias("runtimeMinutes"), "genres", "directors", "writers",
        ),
    }
    paths = {name: scratch_path(spark, name) for name in parts}
    for name, part in parts.items():
        St.write_tsv(part, paths[name], header=name != "queries")
    return paths


@query
def title_text_join(spark, sf):
    """Basics, crew and ratings read as text, joined, two kinds kept; a query file read beside them."""
    paths = title_files(spark, sf)
    joined = C.build_catalog(
        St.read_ratings(spark, paths["ratings"]), St.read_basics(spark, paths["basics"]), St.read_crew(spark, paths["crew"]), ["movie", "tvMovie"]
    )
    wanted = C.as_queries(St.read_queries(spark, paths["queries"])).select("title").distinct().withColumn("asked", F.lit(1))
    rows = joined.join(wanted, "title", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    return rows.withColumns({name: X.join_list(F.col(name)) for name in C.LISTS})


@query
def attribute_predict_text(spark, sf):
    """The whole first program on text files: join, keep one kind, predict the query file; means per query title."""
    paths = title_files(spark, sf)
    catalog = written(
        C.build_catalog(
            St.read_ratings(spark, paths["ratings"]), St.read_basics(spark, paths["basics"]), St.read_crew(spark, paths["crew"]), ["movie"]
        ),
        "catalog",
    )
    batch = written(C.as_queries(St.read_queries(spark, paths["queries"])), "queries")
    predicted = P.attribute_predict(catalog, batch, kinds=["movie"]).distinct()
    named = batch.select("qid", "title").join(predicted, "qid")
    out = named.groupBy("title").agg(F.count(F.lit(1)).alias("asked"), F.avg("predicted").alias("predicted"))
    return rounded(out, "predicted")


@query
def shuffled_split(spark, sf):
    """The hold-out in random order, compared as a set."""
    _, test = R.systematic_split(standin.catalog(spark, sf).select("id", "votes", "rating"))
    return R.shuffled(test, seed=7)


@query
def profile_all(spark, sf):
    """All summaries of one stored table in long form: (summary, name, number)."""
    rows = standin.stored_catalog(spark, sf, "id", "flag", *Pr.NUMBERS, *C.LISTS)
    train, test = R.systematic_split(rows.select("id", "votes", "rating"))
    found = Pr.profile(rows, train, test)
    named = {
        "summary": (F.col("column"), F.col("n")),
        "flagged": (F.lit("flag"), F.col("flagged")),
        "distinct": (F.col("list"), F.col("n_distinct")),
        "genre_frequency": (F.col("token"), F.col("n")),
        "top_directors": (F.col("token"), F.col("n")),
        "raw_directors": (F.col("value"), F.col("n")),
        **{f"histogram_{part}": (F.col("bin").cast("string"), F.col("n")) for part in ("all", "train", "test")},
    }
    parts = [found[k].select(F.lit(k).alias("summary"), n.alias("name"), v.cast("long").alias("number")) for k, (n, v) in named.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def feature_tsv_roundtrip(spark, sf):
    """Wide feature table written and read back: every position a number again."""
    path = scratch_path(spark, "features")
    features, names = Fe.build_features(standin.stored_catalog(spark, sf, *FEATURE_COLUMNS), KINDS)
    # the wide table's column names: as many as a row has columns
    columns = Fe.column_names([row["name"] for row in names.orderBy("pos").collect()])
    St.write_tsv(Fe.wide_features(features, columns), path)
    back = Fe.narrow_features(St.read_features(spark, path, columns), columns)
    cells = back.select(
        "id", F.col("vector.size").alias("length"), F.explode(F.arrays_zip("vector.indices", "vector.values")).alias("e")
    )
    out = cells.select("id", "length", F.col("e.indices").alias("pos"), F.col("e.values").alias("value"))
    return rounded(out, "value")
