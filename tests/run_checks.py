"""Compare chosen queries (all without arguments) with their SQL."""

import sys
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).parent)]

from oracle_check import compare, connect  # noqa: E402

import quayside.plans.catalog  # noqa: E402,F401
from quayside.plans.registry import ORACLES, QUERIES  # noqa: E402
from quayside.session import build_session  # noqa: E402

sf = "/root/testdata/sf0.01"
args = sys.argv[1:]
if args and args[0].startswith("/"):
    sf = args.pop(0)
spark = build_session(
    master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"}
)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
bad = 0
for name, fn in QUERIES.items():
    if args and not any(name.startswith(a) for a in args):
        continue
    try:
        said = compare(spark, con, sf, name, fn, ORACLES.get(name))
    except Exception as e:  # report and go on to the next query
        said = "".join(traceback.format_exception_only(e))[:1500]
    if said:
        bad += 1
        print(f"FAIL {name}: {said}", flush=True)
print("bad", bad)
