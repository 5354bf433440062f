"""Command line: steps in the order given, over the graph read so far.

    python -m gossamer a.n3 b.rdf --think --filter=rules.n3 --sparql=query.rq --ntriples

Inputs are files. Steps: --rules, --think[=file], --apply=file, --filter=file, --solve=file (facts and a query in one
file: its rules' conclusions replace the graph), --query=file, --sparql=file, --patch=file, --why (the proof of what rules
gave, in the reason vocabulary, replaces the graph), --purge, --purge-rules, --data, --reify, --dereify, --flatten,
--unflatten, --closure=flags, --definitive, --size.

From there on: --n3[=flags], --rdf[=flags], --ntriples say the syntax of inputs and of the output; --language=x and
--languageOptions=flags are the same in two options; --base=address is the output's base; --ugly and --bySubject put
statements out one by one and by subject; --pipe writes every input as it comes and keeps nothing; --strings puts out
log:outputString texts; --no nothing. --help and --revision print and end. What follows --with is for os:argv.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

import gossamer


def run(spark: SparkSession, args: list[str]) -> str:
    from gossamer.operators import transforms
    from gossamer.plans import proof
    from gossamer.plans import rules as R
    from gossamer.plans.graphs import Graph, Session
    from gossamer.sources import ntriples, rdfxml, results
    from gossamer.sources.n3_writer import graph_text

    session, out, form, flags, base, reading, pipe = Session(spark), "", "n3", "", "", "", False
    graph = Graph(session, R.empty(spark), [])
    rules_from = lambda name: session.load(name).rules
    told, used = graph.quads, []

    def text(g: Graph) -> str:
        if form == "no":
            return ""
        if form == "ntriples":
            return "".join(r.value + "\n" for r in ntriples.lines(g.quads).orderBy("value").collect())
        if form == "rdf":
            return rdfxml.write([(r.s, r.p, r.o) for r in g.statements.distinct().collect()], g.prefixes, flags, base)
        return g.output_strings() if form == "strings" else graph_text(g, flags, base)

    if "--with" in args:
        args = args[: args.index("--with")]
    for a in args:
        option, _, value = a.partition("=")
        if not a.startswith("--"):
            if reading:
                session.document(a, session.fetch(a), reading)
            one = session.load(a)
            if pipe:
                out += text(one)
            else:
                graph, told = graph.union(one), told.unionByName(one.quads)
        elif option == "--rules":
            used += graph.rules
            graph = graph.apply()
        elif option == "--think":
            rules = rules_from(value) if value else graph.rules
            used += rules
            graph = graph.think(rules)
        elif option == "--apply":
            used += rules_from(value)
            graph = graph.apply(rules_from(value))
        elif option == "--filter":
            graph = graph.filter(rules_from(value))
        elif option == "--solve":
            graph = graph.union(session.load(value)).think().filter(rules_from(value))
        elif option == "--query":
            graph = graph.query(session.document(value))
        elif option == "--sparql":
            df = graph.sparql(session.fetch(value))
            if df.columns != ["s", "p", "o"]:
                return out + results.to_xml(df)
            graph = graph.like(df.selectExpr("'' AS g", "s", "p", "o"))
        elif option == "--patch":
            graph = graph.like(transforms.patch(graph.quads, session.document(value)))
        elif option == "--why":
            found = proof.reasons(graph.quads, used) if used else None
            graph = graph.like(told if found is None else session_quads(session, proof.graph(found)))
        elif option == "--purge":
            graph = graph.like(transforms.purge(graph.quads))
        elif option in ("--data", "--purge-rules"):
            graph = graph.like(transforms.data_only(graph.quads))
        elif option in ("--reify", "--dereify", "--flatten", "--unflatten"):
            graph = graph.like(getattr(transforms, option[2:])(graph.quads))
        elif option == "--closure":
            graph = graph.closure(value)
        elif option == "--definitive":
            graph = graph.routed()
        elif option == "--size":
            out += f"{graph.size()}\n"
        elif option in ("--n3", "--rdf", "--language"):
            form = value if option == "--language" else option[2:]
            flags, reading = "" if option == "--language" else value, {"rdf": "rdf", "n3": "n3"}.get(form, "")
        elif option == "--languageOptions":
            flags = value
        elif option in ("--ugly", "--bySubject"):
            form, flags = "n3", "ads" if option == "--ugly" else "ad"
        elif option == "--base":
            base = value
        elif option == "--pipe":
            pipe = True
        elif option in ("--ntriples", "--strings", "--no"):
            form = option[2:]
        elif option == "--help":
            return __doc__
        elif option == "--revision":
            return f"gossamer, Spark {spark.version}\n"
        else:
            raise SystemExit(f"{a}: no such option\n{__doc__}")
    return out if pipe else out + text(graph)


def session_quads(session, quads):
    """quads whose quoted graphs the session knows, so that they can be written out."""
    from gossamer.sources.n3 import Formula

    inner: dict[str, list] = {}
    for r in quads.where("g != ''").collect():  # a proof that is printed
        inner.setdefault(r.g, []).append((r.s, r.p, r.o))
    session.formulas.update({g: Formula(statements) for g, statements in inner.items()})
    return quads


if __name__ == "__main__":
    s = SparkSession.builder.appName("gossamer").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    gossamer.ship(s)
    sys.stdout.write(run(s, sys.argv[1:]))
