"""Command line: status, pub, sub, config-check over a broker's folder.

    python -m streamroute status DIR
    python -m streamroute pub DIR TOPIC PAYLOAD
    python -m streamroute sub DIR PATTERN [--count N]
    python -m streamroute config-check FILE.yaml
"""

from __future__ import annotations

import argparse
import json
import sys
import uuid


def check(text: str) -> list[str]:
    """What is wrong with a control file: invalid filters, transforms and patterns."""
    from streamroute.operators.filters import VariantFields, compile_filter
    from streamroute.sources import config

    bad = []
    try:
        rules = config.rules(text)
        config.settings(text)
    except (ValueError, KeyError, AttributeError, TypeError) as e:
        return [f"{type(e).__name__}: {e}"]
    for r in rules:
        for where in [r.where, *(t.where for t in r.deliver)]:
            try:
                if where:
                    compile_filter(where, VariantFields("data"), "payload")
            except ValueError as e:
                bad.append(f"{r.name}: {where}: {e}")
    return bad


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("streamroute")
    sub = p.add_subparsers(dest="what", required=True)
    for name, args in (("status", ["dir"]), ("pub", ["dir", "topic", "payload"]), ("sub", ["dir", "pattern"]), ("config-check", ["file"])):
        one = sub.add_parser(name)
        for a in args:
            one.add_argument(a)
        if name == "sub":
            one.add_argument("--count", type=int)
    a = p.parse_args(argv)
    from streamroute.session import local_session

    if a.what == "config-check":
        local_session()  # filters compile to columns
        bad = check(open(a.file, encoding="utf-8").read())
        print("\n".join(bad) or "ok")
        return bool(bad)
    from streamroute.broker import Broker
    from streamroute.operators.topics import route

    spark = local_session()
    b = Broker(spark, a.dir)
    if a.what == "status":
        print(json.dumps({"events": b.events().count(), "subscriptions": len(b.subscriptions()), "pending": b.pending().count()}))
    elif a.what == "pub":
        one = spark.createDataFrame([(0, uuid.uuid4().hex, a.topic, a.payload)], "i bigint, msg_id string, topic string, payload string")
        print(json.dumps(b.publish(one, "i").first().asDict()))
    else:
        hit = route(b.events(), spark.createDataFrame([(a.pattern,)], "pattern string")).orderBy("ingest_seq")
        for r in (hit.limit(a.count) if a.count is not None else hit).toLocalIterator():
            print(json.dumps({"msg_id": r["msg_id"], "topic": r["topic"], "payload": r["payload"]}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
