from epochwright.operators import discovery
from epochwright.sources import tables as sources
from epochwright.sinks import tables as sinks

SUBJECTS, NIGHTS = range(30, 34), (1, 2)


def _name(subject, night, side, mark="E"):
    ends = {"signal": f"{mark}0-PSG.edf", "annotations": f"{mark}C-Hypnogram.edf"}
    return f"SC4{subject:02d}{night}{ends[side]}"


# every night of every subject, but the last annotation file; other links in between
NAMES = [_name(s, n, side) for side in ("annotations", "signal") for s in SUBJECTS for n in NIGHTS]
NAMES.remove(_name(33, 2, "annotations"))
NAMES[3:3] = ["readme.txt", "../"]


def _names(spark, names=NAMES):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, pos int")


def test_pairs(spark):
    got = discovery.pair_recordings(_names(spark)).orderBy("subject_id", "night").collect()
    want = [(s, n) for s in SUBJECTS for n in NIGHTS if (s, n) != (33, 2)]
    assert [(r["subject_id"], r["night"]) for r in got] == [(f"SC{s}", n) for s, n in want]
    assert [r["hypnogram_name"] for r in got] == [_name(s, n, "annotations") for s, n in want]


def test_unpaired(spark):
    got = discovery.unpaired_names(_names(spark)).collect()
    assert [(r["key"], r["missing"]) for r in got] == [("SC4332", "annotations")]


def test_last_name_of_a_key_wins(spark):
    names = [_name(30, 1, "signal"), _name(30, 1, "signal", "F"), _name(30, 1, "annotations")]
    got = discovery.pair_recordings(_names(spark, names)).collect()
    assert [r["psg_name"] for r in got] == [names[1]]
    # over pages the page counts before the place on it
    paged = spark.createDataFrame([(names[1], 1, 9), (names[0], 2, 0), (names[2], 1, 0)], "name string, page int, pos int")
    assert discovery.pair_recordings(paged).first()["psg_name"] == names[0]


def test_pair_with_a_foreign_stem_is_dropped(spark):
    names = ["ST7011J0-PSG.edf", "ST7011JP-Hypnogram.edf"]
    assert discovery.pair_recordings(_names(spark, names)).isEmpty()


def test_listing_keeps_first_occurrence(spark):
    pages = spark.createDataFrame(
        [(1, "<a>SC4001E0-PSG.edf</a> SC4001EC-Hypnogram.edf SC4001E0-PSG.edf"), (2, "SC4001EC-Hypnogram.edf x.edf")],
        "id int, html string",
    )
    got = {r["name"]: (r["page"], r["pos"]) for r in discovery.listed_names(pages, "id", "html").collect()}
    assert got == {"SC4001E0-PSG.edf": (1, 0), "SC4001EC-Hypnogram.edf": (1, 1)}


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifest.csv")
    sinks.write_manifest(discovery.pair_recordings(_names(spark)), "/raw/", path)
    got = sources.read_manifest(spark, path)
    assert got.dtypes[1] == ("night", "int")
    assert got.orderBy("psg_path").first()["psg_path"] == f"/raw/{_name(30, 1, 'signal')}"


def test_files_on_storage(spark, tmp_path):
    (tmp_path / "a.edf").write_bytes(b"1234")
    (tmp_path / "empty.edf").write_bytes(b"")
    present = sources.list_files(spark, str(tmp_path))
    wanted = spark.createDataFrame([("a.edf",), ("empty.edf",), ("c.edf",)], "name string")
    missing = discovery.missing_files(wanted, present)
    assert sorted(r["name"] for r in missing.collect()) == ["c.edf", "empty.edf"]
    assert [r["name"] for r in discovery.oversized_files(present, 3).collect()] == ["a.edf"]
