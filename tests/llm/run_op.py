"""Run operator queries next to their SQL: python tests/llm/run_op.py FOLDER NAME..."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[2]), str(Path(__file__).resolve().parents[1])]


def main():
    from oracle import compare, connect

    from quillmesh.llm.oracles import ORACLES
    from quillmesh.llm.queries import QUERIES
    from quillmesh.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for n in names:
        t0 = time.time()
        df = QUERIES[n](spark, folder)
        rows = df.count()
        t1 = time.time()
        diff = compare(spark, con, n, QUERIES[n], ORACLES[n], folder) if n in ORACLES else "no SQL"
        print(n, rows, f"{t1 - t0:.1f}s", diff, flush=True)
        df.show(4, 60)


if __name__ == "__main__":
    main()
