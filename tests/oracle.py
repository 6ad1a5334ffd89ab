"""Runs queries beside their SQL and compares rows: ``python tests/oracle.py sf_dir NAME...``."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


def plain(value):
    """A value that compares alike from both engines."""
    if isinstance(value, float):
        return None if value != value else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def sql_rows(sf_dir, sql):
    """Sorted rows of ``sql`` over the folder's tables, with the columns by name."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            at = os.path.join(sf_dir, f)
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    """Sorted rows of a DataFrame, with the columns by name."""
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)


def main(sf_dir, names):
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or list(queries):
        t = time.time()
        try:
            got = spark_rows(queries[name](spark, sf_dir))
            took = time.time() - t
            if name not in oracle:
                print(f"{name}: {len(got[1])} rows, {took:.1f} s, no SQL", flush=True)
                continue
            want = sql_rows(sf_dir, oracle[name])
            same = got == want
            print(f"{name}: {'same' if same else 'DIFFERENT'}, {len(got[1])} and {len(want[1])} rows, {took:.1f} s, SQL {time.time() - t - took:.1f} s", flush=True)
            if not same:
                bad += 1
                a, b = set(got[1]), set(want[1])
                print("  columns", got[0], want[0], "\n  only here", sorted(a - b, key=repr)[:3], "\n  only SQL", sorted(b - a, key=repr)[:3], flush=True)
        except Exception as e:
            bad += 1
            print(f"{name}: FAILED {str(e)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
