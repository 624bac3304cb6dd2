"""Run named queries against DuckDB: python tests/check.py SF_DIR [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import difference, duck  # noqa: E402

from billscope.queries import ORACLES, QUERIES  # noqa: E402
from billscope.shared import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(spark__sql__shuffle__partitions="8", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for name, function in QUERIES.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            frame = function(spark, sf_dir)
            if name in ORACLES:
                problem = difference(frame, duck(sf_dir), ORACLES[name])
            else:
                problem = None if frame.count() >= 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:32s} {'ok' if problem is None else 'BAD'} {time.time() - start:6.1f}s {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("bad:", bad)
