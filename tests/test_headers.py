"""First lines of station files, read in part."""

import os

from tidepanel.session import scratch_path
from tidepanel.sources import io


class Counted:
    def __init__(self, data: bytes):
        self.data, self.taken = data, 0

    def read(self, n: int) -> bytes:
        part = self.data[self.taken : self.taken + n]
        self.taken += len(part)
        return part


def test_a_first_line_takes_no_more_than_its_own_blocks():
    long = b"c" * (3 * io.HEAD_BYTES) + b"\n"
    for data, line in ((b"a,b\r\n1,2\n", "a,b"), (b"a\rb\n", "a"), (b"only", "only"), (b"", None), (b"\n1", ""), (b"\xef\xbb\xbfa\n", "a"), (long, "c" * (3 * io.HEAD_BYTES))):
        assert io.first_line(Counted(data)) == line
    big = Counted(b"a,b\n" + b"1,2\n" * 1_000_000)
    io.first_line(big)
    assert big.taken == io.HEAD_BYTES


def test_headers_by_range_equal_those_of_a_scan(spark):
    root = scratch_path(spark, "heads").removeprefix("file:")
    files = {"a/abcdewq2020.csv": "T,x\n1,2\n", "a/b/fghijNUT2021.CSV": "T, y \n" + "1,2\n" * 200_000, "notes2020.csv": "n\n", "a/abcdewq2021.csv": "", "c/readme.txt": "T\n"}
    for name, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write(content)
    parts = [sorted((r["path"].rsplit("/", 1)[1], r["header"]) for r in io.headers(spark, root, by_range).collect()) for by_range in (True, False)]
    assert parts[0] == parts[1] == [("abcdewq2020.csv", "T,x"), ("fghijNUT2021.CSV", "T, y "), ("notes2020.csv", "n")]
    found = {(r["region"], r["station"], r["file_type"]) for r in io.discover(spark, root).collect()}
    assert found == {("abc", "abcde", "wq"), ("fgh", "fghij", "nut")}
    nut = io.read_station_files(spark, root, "nut")
    assert nut.count() == 200_000 and "y" in nut.columns
