"""Print the physical plan of registered queries (after running them, so AQE's
final plan — coalesced partitions, broadcast switches, reused exchanges — shows).

usage: python tools/show_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(argv: list[str]) -> None:
    from scorewell.plans.catalog import load_all
    from scorewell.session import local_session

    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = local_session()
    queries = load_all()
    for name in names:
        df = queries[name].run(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        print(f"===== {name} =====")
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
