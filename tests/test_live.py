"""The live graph equals a rebuild after adds, changes, renames and deletes, and does no more than the change asks for."""

import datetime

import pytest

from quillgraph.operators import graph, parse, stats
from quillgraph.plans import pipelines
from quillgraph.streaming.live import LiveGraph
from quillgraph.streaming.refresh import follow, refresh_live
from tests import vault

SCHEMA = "rel_path string, file_name string, raw string, size_bytes long, mtime timestamp"
DAY = datetime.datetime(2024, 1, 1)


def listing(spark, notes):
    """notes: path -> (text, day)."""
    rows = [(p, p.split("/")[-1], x, len(x.encode()), DAY + datetime.timedelta(days=d)) for p, (x, d) in notes.items()]
    return spark.createDataFrame(rows, SCHEMA)


def same_as_rebuilt(spark, live, notes):
    nodes = parse.nodes(listing(spark, notes))
    names = graph.resolver(nodes)
    edges = graph.resolve(graph.raw_links(nodes), names)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(live.names()) == rows(names.select("canonical", "uid"))
    assert rows(live.edges()) == rows(edges.select("src", "pos", "raw", "dst", "resolved"))
    assert rows(live.degrees()) == rows(graph.degrees(nodes, edges).select("uid", "out_degree", "in_degree", "degree"))
    assert rows(live.nodes().select("uid", "rel_path", "summary", "raw")) == rows(nodes.select("uid", "rel_path", "summary", "raw"))


START = {
    "A/Acme.md": ("---\nname: Acme Mining\naliases: [ACM]\n---\n[[Lithium]] [[Ghost]] [[acm]]", 0), "A/Lithium.md": ("Used by [[Acme Mining]] and [[Acme]].", 0),
    "B/Twin.md": ("first [[Acme]]", 0), "A/Twin.md": ("hidden [[Lithium]]", 0), "C/Far.md": ("[[Twin]] [[Ghost]]", 0), "C/Lone.md": ("no links", 0)}


@pytest.fixture(scope="module")
def live(spark, tmp_path_factory):
    return LiveGraph(spark, str(tmp_path_factory.mktemp("live")), parts=4)


def test_changes_one_after_the_other(spark, live):
    notes = dict(START)
    steps = [
        ({}, set()),  # the first state
        ({"D/Ghost.md": ("appears", 1), "A/Acme.md": ("---\nname: Acme Holding\n---\n[[Lithium]]", 2)}, set()),  # dangling links find it, an alias goes
        ({"Z/Claim.md": ("---\nname: Lithium\n---\n[[Claim]]", 3)}, {"B/Twin.md"}),  # a later path takes a name, the overridden twin wins
        ({"E/Far.md": notes["C/Far.md"], "A/Acme.md": ("---\nname: Acme Holding\n---\n[[Lithium]]", 9)}, {"C/Far.md", "Z/Claim.md", "D/Ghost.md"}),  # moved, touched, names go back
        ({}, set(notes) | {"E/Far.md"})]
    for come, gone in steps:
        notes = {p: v for p, v in notes.items() if p not in gone} | come
        live.update(listing(spark, notes) if notes else listing(spark, START).limit(0))
        if len(come) + len(gone) > 1 and notes:
            same_as_rebuilt(spark, live, notes)
    assert live.edges().count() == live.names().count() == live.degrees().count() == 0


def test_work_follows_the_change(spark, tmp_path):
    notes = {f"N/n{i}.md": (f"[[n{i + 1}]] [[hub]]", 0) for i in range(300)} | {"N/hub.md": ("the hub", 0), "N/m.md": ("x", 0)}
    live = LiveGraph(spark, str(tmp_path / "g"), parts=8)
    first = live.update(listing(spark, notes))
    assert (first.read, first.deleted, first.sources) == (302, 0, 302)
    notes["N/n7.md"] = ("[[n9]]", 1)
    one = live.update(listing(spark, notes))
    assert (one.read, one.deleted, one.names, one.sources) == (1, 0, 0, 1)
    del notes["N/n50.md"]
    gone = live.update(listing(spark, notes))
    assert (gone.read, gone.deleted, gone.names, gone.sources) == (0, 1, 1, 2)  # itself and the one that links to it
    assert live.update(listing(spark, notes)).sources == 0
    same_as_rebuilt(spark, live, notes)
    again = LiveGraph(spark, str(tmp_path / "g"), parts=8)
    same_as_rebuilt(spark, again, notes)


def test_an_update_leaves_few_files(spark, tmp_path):
    """However many tasks have the rows, a part of a version is one file until it is large, and each table is written once."""
    notes = {f"N/n{i}.md": (f"[[n{i + 1}]] [[hub]]", 0) for i in range(400)} | {"N/hub.md": ("the hub", 0)}
    live = LiveGraph(spark, str(tmp_path / "g"), parts=4)
    live.update(listing(spark, notes).repartition(24))
    for table in ("notes", "claims", "names", "links", "degrees"):
        assert all(len(list(part.glob("*.parquet"))) == 1 for part in (tmp_path / "g" / table).glob("version=*/part=*"))
    assert all(len(list(part.glob("*.parquet"))) <= 2 for part in (tmp_path / "g" / "edges").glob("version=*/part=*"))  # edges, and marks of notes without any
    same_as_rebuilt(spark, live, notes)


def test_a_failed_attempt_is_never_read(spark, tmp_path, monkeypatch):
    live = LiveGraph(spark, str(tmp_path / "g"), parts=4)
    live.update(listing(spark, START))
    notes = START | {"C/Lone.md": ("[[Acme]] now", 5)}
    append = LiveGraph._append

    def fails(self, name, rows, version):
        if name == "edges":
            raise OSError("lost")
        append(self, name, rows, version)

    monkeypatch.setattr(LiveGraph, "_append", fails)
    with pytest.raises(OSError):
        live.update(listing(spark, notes))
    monkeypatch.undo()
    same_as_rebuilt(spark, live, START)
    live.update(listing(spark, notes))
    same_as_rebuilt(spark, live, notes)


def test_a_folder_of_notes_is_followed(spark, tmp_path):
    root = vault.write(tmp_path / "notes")
    live = LiveGraph(spark, str(tmp_path / "g"), parts=4)
    follow(spark, root, str(tmp_path / "checkpoint"), live).awaitTermination(300)
    rows = lambda df: sorted(map(str, df.select("src", "pos", "raw", "dst", "resolved").collect()))
    assert rows(live.edges()) == rows(pipelines.build_index(spark, root).edges)
    (tmp_path / "notes" / "Land" / "Commodities" / "Lithium.md").unlink()
    (tmp_path / "notes" / "Land" / "Ghost Town.md").write_text("[[Acme Co]]")
    change = refresh_live(spark, root, live)
    spark.catalog.clearCache()  # the index of before
    assert (change.read, change.deleted) == (2, 1)  # the file that is no UTF-8 is looked at each time
    assert rows(live.edges()) == rows(pipelines.build_index(spark, root).edges)


def test_fingerprints_tell_replacements(spark):
    rows = [(f"p{i}", i, i * 2) for i in range(50)]
    of = lambda r: tuple(stats.multiset_fingerprint(spark.createDataFrame(r, "path string, time long, size long"), "path", "time", "size").first())
    base = of(rows)
    assert of(rows[::-1]) == base
    others = [rows[:-1] + [("older", 3, 1)], [("renamed", *rows[0][1:])] + rows[1:], [(rows[0][0], 40, 0)] + rows[1:], rows[1:], [*rows, rows[0]], [(None, 0, 0)] + rows[1:]]
    assert len({base, *map(of, others)}) == 7
    assert stats.changed_fingerprint(base, of([rows[3]]), of([("new", 1, 1)])) == of([r for r in rows if r != rows[3]] + [("new", 1, 1)])
    assert of([]) == (0, "0")
