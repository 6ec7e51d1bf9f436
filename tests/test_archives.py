import io
import tarfile

from driftgate.functions.udfs import register
from driftgate.sources.archives import archive_manifest, explode_archives
from driftgate.settings import DEFAULT_FACTORIES


def make_tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, size in members:
            info = tarfile.TarInfo(name)
            info.size = size
            tar.addfile(info, io.BytesIO(b"x" * size))
        folder = tarfile.TarInfo("folder.mp4")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


def test_members(spark, tmp_path):
    make_tar(tmp_path / "none.tar", [("a.json", 3)])
    make_tar(tmp_path / "one.tar", [("a.mp4", 10), ("a.json", 3)])
    make_tar(tmp_path / "four.tar", [(f"{i}.mp4", i) for i in range(4)])
    (tmp_path / "damaged.tar").write_bytes(b"\x01" * 700)
    names = ["none", "one", "four", "damaged", "missing"]
    manifest = spark.createDataFrame([(n, str(tmp_path / f"{n}.tar")) for n in names],
                                     "name string, path string")
    want = {("one", "a.mp4", 10)} | {("four", f"{i}.mp4", i) for i in range(4)}
    got = explode_archives(manifest).collect()
    assert {(x.name, x.member, x.size) for x in got} == want and len(got) == 5
    uris = explode_archives(manifest.selectExpr("name", "concat('file://', path) AS path"))
    assert {(x.name, x.member, x.size) for x in uris.collect()} == want

    register(spark)
    manifest.createOrReplaceTempView("manifest")
    lateral = spark.sql("SELECT name, member, size FROM manifest, "
                        "LATERAL archive_members(manifest.path)")
    assert {tuple(x) for x in lateral.collect()} == want


def test_manifest(spark):
    paths = ["factory_001/workers/worker_007/part00.tar", "factory_001/part01.tar",
             "factory_001/workers/worker_007/part00.json", "factory_0011/workers/w/a.tar",
             "factory_002/workers/worker_001/b.tar", "factory_999/workers/w/c.tar",
             "factory_001.tar"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {(x.path, x.factory_id, x.worker_id) for x in archive_manifest(df).collect()}
    assert got == {(paths[0], "factory_001", "worker_007"),
                   (paths[1], "factory_001", "unknown"),
                   (paths[4], "factory_002", "worker_001")}
    assert archive_manifest(df, ["factory_999"]).count() == 1
    assert len(DEFAULT_FACTORIES) == 8
