import gzip
import hashlib
import random

import pytest

from sedgetable.sources import manifest as M
from test_sources import put


@pytest.mark.parametrize("split", [None, "500"])
def test_manifest_of_split_files(spark, tmp_path, split):
    rnd = random.Random(7)
    files = {
        "lf.txt": b"a\nb\n", "open.txt": b"a\nb", "crlf.txt": b"a\r\nb\r\n", "cr.txt": b"a\rb\r", "mixed.txt": b"x\r\ny\nz\r\0\r", "one.txt": b"\n", "blank.txt": b"\n\n\r\n\n",
        "bytes.bin": bytes(rnd.choice([0, 10, 13, 65, 255]) for _ in range(4001)), "long.txt": b"line \xff\n" * 900, "packed.gz": gzip.compress(b"a\nb\n" * 100),
    }
    for name, data in files.items():
        put(tmp_path, name, data)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = {r["file"]: tuple(r)[1:] for r in M.source_manifest(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, data in files.items():
        crlf = data.count(b"\r\n")
        assert found[name] == (len(data), hashlib.sha256(data).hexdigest(), crlf, data.count(b"\n") - crlf, data.count(b"\r") - crlf, data.count(0)), name
    assert set(found) == set(files)
