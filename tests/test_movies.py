import pytest

from vellum.cli import main
from vellum.plans.connection import connect
from vellum.sources import movies
from vellum.streaming.feeds import changes_since, upsert_stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("movies")
    (d / "movies.csv").write_text('movieId,title,genres\n1,Plain (1995),Adventure|Sci-Fi\n2,"Comma, The (Best) (2001)",(no genres listed)\n3,No Year,Drama|Drama\n4,Unlinked (1980),\n')
    (d / "links.csv").write_text("movieId,imdbId,tmdbId\n1,0114709,862\n2,0113497,\n3,,\n")
    (d / "tags.csv").write_text("userId,movieId,tag,timestamp\n1,2,funny,1139045764\n1,2,sad,1139045764\n2,1,funny,1139045764\n3,1,old,1139045765\n3,3,odd,1139045766\n")
    ratings = [(u, 1, 4.0) for u in range(100)] + [(u, 2, 5.0) for u in range(99)] + [(u, 3, 3.5 if u % 2 else 4.5) for u in range(120)]
    (d / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(f"{u},{m},{s},{1_000_000_000 + u}\n" for u, m, s in ratings))
    return str(d)


def test_records(spark, folder):
    rows = {r.id: r for r in movies.movie_records(spark, f"file://{folder}").collect()}
    assert (rows[1].title, rows[1].year, rows[1].genres, rows[1].imdb_id, rows[1].tmdb_id) == ("Plain", 1995, ["adventure", "sci_fi"], 114709, 862)
    assert (rows[2].title, rows[2].year, rows[2].genres, rows[2].tmdb_id) == ("Comma, The (Best)", 2001, ["_no_genres_listed_"], None)
    assert (rows[3].title, rows[3].year, rows[3].genres) == ("No Year", None, ["drama"]) and rows[4].imdb_id is None


def test_commands(spark, folder, tmp_path):
    out: list[str] = []
    root = ["--root", f"file://{tmp_path}"]
    assert main([*root, "load-db", f"file://{folder}"], spark, out.append) == 0
    db_root = next(x for x in out if x.startswith("Database root")).split()[-1]
    db = connect(spark, f"file://{tmp_path}").load_database(db_root)
    assert [(t["name"], t["count"]) for t in db.list_tables()] == [("movies", 4), ("ratings", 319), ("tags", 5)]
    assert [(r.id, r.tags) for r in movies.most_tagged(db, 2).collect()] == [(1, 2), (2, 2)]
    assert [(r.id, r.rating) for r in movies.best_rated(db).collect()] == [(1, 4.0), (3, 4.0)]
    out.clear()
    assert main([*root, "most-tagged", db_root, "1"], spark, out.append) == 0 and "1\t2\tPlain\t1995" in out
    out.clear()
    assert main([*root, "best-rated", db_root], spark, out.append) == 0 and out[0] == "id\trating\ttitle\tyear" and out[2].endswith("4.0\tNo Year\t")
    assert main([], spark, out.append) == 1 and main(["dance"], spark, out.append) == 1
    assert main(["load-db"], spark, out.append) == 3 and main(["most-tagged", "x", "y"], spark, out.append) == 3
    assert main(["--nonsense"], spark, out.append) == 2


def test_streams(spark, tmp_path):
    connection = connect(spark, f"file://{tmp_path}/store")
    connection.commit("live", connection.create_db("live").create_table("t", primary_key="id"))
    inbox, mark = f"file://{tmp_path}/inbox", f"file://{tmp_path}/mark"

    def send(rows):
        spark.createDataFrame(rows, "id long, n long").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("id long, n long").parquet(inbox)
        upsert_stream(stream, connection, "live", "t", mark, update_field={"n": "sum"}).awaitTermination()

    send([(1, 1), (2, 5), (1, 2)])
    first = connection.open_db("live").version
    send([(1, 10), (3, 1)])
    table = connection.open_db("live").get_table("t")
    assert table.records() == [{"id": 1, "n": 13}, {"id": 2, "n": 5}, {"id": 3, "n": 1}]
    changes, version = changes_since(connection, "live", "t", first)
    assert sorted((r.id, r.change) for r in changes.collect()) == [(1, "updated"), (3, "added")] and version == connection.open_db("live").version
