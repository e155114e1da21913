"""The example data set: movies with links, tags and ratings from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_as_absent, genres_of, title_of, year_of
from ..operators.stats import collect_table_stats, print_table_stats
from ..plans.connection import Connection
from ..plans.database import Database
from ..plans.jobs import job_group
from ..plans.table import Table

#: Settings of the tables.
MOVIES = {"primary_key": "id", "lexicoder": "integer", "families": {"links": ["imdb_id", "tmdb_id"]}, "partition_limit": 5_000}
TAGS = {"primary_key": ["user", "movie", "value"], "lexicoder": ("tuple", "integer", "integer", "string"), "partition_limit": 10_000}
RATINGS = {"primary_key": ["user", "movie"], "lexicoder": ("tuple", "integer", "integer"), "partition_limit": 25_000}
#: Ratings that a movie needs to be ranked.
LEAST_RATINGS = 100


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header line, in the given schema."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(schema).csv(path)


def movie_records(spark: SparkSession, folder: str) -> DataFrame:
    movies = read_csv(spark, f"{folder}/movies.csv", "movieId long, title string, genres string")
    links = read_csv(spark, f"{folder}/links.csv", "movieId long, imdbId string, tmdbId string")
    movies = movies.select(F.col("movieId").alias("id"), title_of(F.col("title")).alias("title"), year_of(F.col("title")).alias("year"), genres_of(F.col("genres")).alias("genres"))
    links = links.select(F.col("movieId").alias("id"), blank_as_absent(F.col("imdbId")).cast("long").alias("imdb_id"), blank_as_absent(F.col("tmdbId")).cast("long").alias("tmdb_id"))
    return movies.join(links, "id", "left")


def tag_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_csv(spark, f"{folder}/tags.csv", "userId long, movieId long, tag string, timestamp long")
    return rows.select(F.col("userId").alias("user"), F.col("movieId").alias("movie"), F.col("tag").alias("value"), F.timestamp_seconds("timestamp").alias("time"))


def rating_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_csv(spark, f"{folder}/ratings.csv", "userId long, movieId long, rating double, timestamp long")
    return rows.select(F.col("userId").alias("user"), F.col("movieId").alias("movie"), F.col("rating").alias("score"), F.timestamp_seconds("timestamp").alias("time"))


def load_table(store, name: str, records: DataFrame, settings: dict, out=print) -> Table:
    with job_group(store.spark, f"load:{name}", f"bulk load of {name}"):
        table = Table.new(store, name, **settings).load_records(records)
    print_table_stats(collect_table_stats(table), out)
    return table


def load_dataset(connection: Connection, folder: str, out=print) -> Database:
    """The database of the three tables, flushed but not published."""
    spark, store = connection.store.spark, connection.store
    db = Database(store, {"title": "Movies"}, {})
    for name, records, settings in (("movies", movie_records, MOVIES), ("tags", tag_records, TAGS), ("ratings", rating_records, RATINGS)):
        db = db.set_table(name, load_table(store, name, records(spark, folder), settings, out))
    return db.flush()


def most_tagged(db: Database, n: int = 10) -> DataFrame:
    """Movies with the most tags; ties by id."""
    top = db.get_table("tags").scan(ordered=False).groupBy(F.col("movie").alias("id")).agg(F.count("*").alias("tags")).orderBy(F.desc("tags"), "id").limit(n)
    movies = db.get_table("movies").scan(fields=["title", "year"], ordered=False)
    return F.broadcast(top).join(movies, "id", "left").orderBy(F.desc("tags"), "id")


def best_rated(db: Database, n: int = 10, least: int = LEAST_RATINGS) -> DataFrame:
    """Movies of the highest mean score among those with ``least`` scores; ties by id."""
    scores = db.get_table("ratings").scan(ordered=False).groupBy(F.col("movie").alias("id")).agg(F.count("score").alias("n"), F.sum("score").alias("s"))
    top = scores.filter(F.col("n") >= least).select("id", (F.col("s") / F.col("n")).alias("rating")).orderBy(F.desc("rating"), "id").limit(n)
    movies = db.get_table("movies").scan(fields=["title", "year"], ordered=False)
    return F.broadcast(top).join(movies, "id", "left").orderBy(F.desc("rating"), "id")
