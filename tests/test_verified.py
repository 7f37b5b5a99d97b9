"""Verification that goes on from signed records of files."""

import glob
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wardline.functions.hashing import GENESIS
from wardline.session import work_folder
from wardline.sources.ledger_table import ledger_append
from wardline.sources.manifest import read_manifest
from wardline.sources.verified import verify_appends

KEY = "a key"


def run(spark, path, key=KEY):
    rows = verify_appends(spark, path, key).orderBy("append_no").collect()
    return [(r["status"], r["n_read"], r["first_bad_id"]) for r in rows]


@pytest.fixture
def ledger(spark, entries_of):
    """A ledger of two appends, of three rows and of two."""
    path = work_folder(spark, "ledger")
    ledger_append(entries_of([(f"a{i}", "t", "PASSED", None) for i in range(3)]), path)
    ledger_append(entries_of([(f"b{i}", "t", "BLOCKED", "x") for i in range(2)], start=1704070000), path)
    return path


def files_of(spark, path, number):
    name = read_manifest(spark, path).appends[number - 1]
    return sorted(glob.glob(f"{path}/append={name}/**/*.parquet", recursive=True))


def edit(file, change):
    """Write a file anew with its rows changed, and without the old checksum beside it."""
    table = pq.ParquetFile(file).read()
    rows = table.to_pylist()
    change(rows)
    pq.write_table(pa.Table.from_pylist(rows, schema=table.schema), file)
    checksum = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
    if os.path.exists(checksum):
        os.remove(checksum)


def test_only_new_appends_are_read(spark, ledger, entries_of):
    assert run(spark, ledger) == [("verified", 3, None), ("verified", 2, None)]
    assert run(spark, ledger) == [("unchanged", 0, None)] * 2
    ledger_append(entries_of([("c", None, "PASSED", None)], start=1704080000), ledger)
    assert run(spark, ledger) == [("unchanged", 0, None)] * 2 + [("verified", 1, None)]


def test_what_is_changed_later_is_found_again_and_again(spark, ledger):
    run(spark, ledger)
    edit(files_of(spark, ledger, 1)[0], lambda rows: rows[1].update(action_taken="PASSED*"))
    for _ in range(2):
        first, second = run(spark, ledger)
        assert first[:2] == ("altered", 3) and first[2] is not None and second == ("unchanged", 0, None)


def test_a_consistent_forgery_is_found_by_the_bytes(spark, ledger):
    import hashlib

    run(spark, ledger)

    def forge(rows):
        previous = GENESIS
        for row in rows:
            row["action_taken"] = "PASSED*"
            row["previous_hash"] = previous
            previous = row["current_hash"] = hashlib.sha256(f"{row['request_id']}{row['tenant_id']}PASSED*{row['rule_violated'] or ''}{previous}".encode()).hexdigest()

    edit(files_of(spark, ledger, 1)[0], forge)
    # No row is wrong in itself, as no first bad id shows; the file is.
    assert run(spark, ledger)[0] == ("altered", 3, None)


def test_lost_and_added_files_and_folders(spark, ledger):
    run(spark, ledger)
    one = files_of(spark, ledger, 1)[0]
    shutil.copy(one, one.replace("part-", "part-9"))
    assert run(spark, ledger)[0][0] == "altered"
    shutil.rmtree(f"{ledger}/append={read_manifest(spark, ledger).appends[1]}")
    assert run(spark, ledger)[1] == ("altered", 0, None)


def test_broken_before_it_was_ever_verified(spark, ledger):
    edit(files_of(spark, ledger, 2)[0], lambda rows: rows[0].update(rule_violated="y"))
    for _ in range(2):
        status, n, bad = run(spark, ledger)[1]
        assert (status, n) == ("broken", 2) and bad is not None


def test_records_of_another_key_do_not_count(spark, ledger):
    run(spark, ledger, "a key of the attacker's")
    assert [r[0] for r in run(spark, ledger)] == ["altered", "altered"]
    with pytest.raises(ValueError, match="key"):
        verify_appends(spark, ledger, "")


def test_no_ledger(spark):
    assert run(spark, work_folder(spark, "none")) == []
