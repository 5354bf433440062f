"""AIR policies: rules with if, then and else under a closed world, and the justification of every assertion.

A policy's rules are active from the start; `then` and `else` may assert statements or activate further rules, which
keep the bindings of the rule above. Assertions and activations go to a fixpoint; only then do the `else` branches of
active rules fire, all together, for the rows whose pattern has no match; then the next fixpoint starts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gossamer import terms as T
from gossamer.operators import bgp
from gossamer.operators.bgp import name
from gossamer.plans import rules as R
from gossamer.plans.graphs import Graph, Session, digest
from gossamer.sources import n3
from gossamer.tables import written
from gossamer.terms import AIR

COMPLIANCE = (f"<{AIR}compliant-with>", f"<{AIR}non-compliant-with>")
#: Fixed value: the vocabulary that traces are written in.
AIRJ = "http://dig.csail.mit.edu/2009/AIR/airjustification#"
JUSTIFICATIONS = "s string, p string, o string, rule string, branch string, label string, hidden boolean, elided boolean, description string, bindings map<string,string>, antecedents array<string>"


class PolicyError(ValueError):
    """A rule that is not well formed."""


@dataclass
class Action:
    kind: str  # assert, rule, import
    target: str
    description: list = field(default_factory=list)


@dataclass
class AirRule:
    id: str
    body: list
    then: list[Action]
    otherwise: list[Action]
    label: str = ""
    hidden: bool = False
    elided: bool = False
    matched_graph: str | None = None

    @property
    def variables(self) -> set[str]:
        return set().union(set(), *(T.variables(t) for p in self.body for t in p))


def air(local: str) -> str:
    return f"<{AIR}{local}>"


class Policies:
    """The rules of policy documents; imports add to them."""

    def __init__(self, session: Session, documents: list[n3.Document]):
        self.session, self.rules, self.top = session, {}, []
        self.by_subject: dict[str, list[tuple]] = {}
        self.plain: list[R.Rule] = []
        self.base = documents[0].base if documents else ""
        for d in documents:
            self.add(d)

    def add(self, document: n3.Document) -> list[str]:
        """Takes a document's policies up; the ids of its top rules."""
        for s, p, o in document.root.statements:
            self.by_subject.setdefault(s, []).append((p, o))
        found = []
        for s, p, o in document.root.statements:
            if p == T.TYPE and o in (air("Policy"), air("RuleSet")):
                found += [r for q, r in self.by_subject[s] if q in (air("rule"), air("goal-rule"))]
        document.formulas.update({g: f for g, f in self.session.formulas.items() if g not in document.formulas})
        self.plain += R.rules_of(document)
        for r in found:
            self.rule(r)
        self.top += [r for r in found if r not in self.top]
        return found

    def values(self, s: str, *properties: str) -> list:
        return [o for p, o in self.by_subject.get(s, []) if p in properties]

    def rule(self, node: str) -> AirRule:
        if node in self.rules:
            return self.rules[node]
        patterns = self.values(node, air("if"), air("pattern"))
        if len(patterns) != 1 or not str(patterns[0]).startswith("F"):
            raise PolicyError(f"{node} has {len(patterns)} air:if patterns, not one")
        types = self.values(node, T.TYPE)
        label = next((T.parts(x)[0] for x in self.values(node, air("label"))), "")
        out = self.rules[node] = AirRule(node, R.as_variables(self.session.formulas[patterns[0][1:]]), [], [], label, air("Hidden-rule") in types, air("Elided-rule") in types or air("Ellipsed-rule") in types, next(iter(self.values(node, air("matched-graph"))), None))
        described = next(iter(self.values(node, air("description"))), "")
        for branch, which in ((out.then, "then"), (out.otherwise, "else")):
            for n in self.values(node, air(which)):
                branch += self.actions(n, described)
        # The older form: assertions and rules on the rule itself.
        out.then += [a for p in ("assert", "rule", "goal-rule") for o in self.values(node, air(p)) for a in self.action(p, o, described)]
        for a in (*out.then, *out.otherwise):
            if a.kind == "rule":
                self.rule(a.target)
        return out

    def actions(self, node: str, described) -> list[Action]:
        description = next(iter(self.values(node, air("description"))), described)
        return [a for p in ("assert", "assert-goal", "rule", "goal-rule", "import") for o in self.values(node, air(p)) for a in self.action(p, o, description)]

    def action(self, p: str, o: str, description) -> list[Action]:
        parts = list(description.items) if isinstance(description, T.Seq) else T.members(description) if isinstance(description, str) and description.startswith("L") else []
        if p in ("rule", "goal-rule"):
            return [Action("rule", o, parts)]
        if p == "import":
            return [Action("import", o, parts)]
        if p == "assert-goal":
            return []
        inner = [o] if str(o).startswith("F") else self.values(o, air("statement"))
        return [Action("assert", f, parts) for f in inner]

    def check(self, r: AirRule, inherited: set[str]) -> None:
        """else needs a pattern that binds nothing new."""
        own = {v for v in r.variables if not v.startswith("?b") and not v.startswith("?" + "_")}
        if r.otherwise and any(v not in inherited for v in own if not self.existential(r, v)):
            raise PolicyError(f"{r.id} has air:else but its pattern binds {sorted(own - inherited)}")

    def existential(self, r: AirRule, v: str) -> bool:
        return any("_:" + v[1:] in f.existentials for f in self.session.formulas.values())

    def towards(self, goals: list[tuple]) -> set[str]:
        """The rules that may bear on statements that match a goal: those that assert one, those whose assertions a rule
        that bears on it looks for, and those that start one. All of them, where a pattern looks into graphs or a rule
        imports others."""
        every = list(self.rules.values())
        if any(p[1] in bgp_free(p) for r in every for p in r.body) or any(a.kind == "import" for r in every for a in (*r.then, *r.otherwise)):
            return set(self.rules)
        needed, kept, plain = list(goals), set(), set()
        while True:
            before = len(kept) + len(plain)
            for r in every:
                actions = [*r.then, *r.otherwise]
                heads = [st for a in actions if a.kind == "assert" for st in self.session.formulas[a.target[1:]].statements]
                bears = any(R.may_match(h, g) for h in R.as_variables(n3.Formula(heads)) for g in needed) or any(a.kind == "rule" and a.target in kept for a in actions)
                if r.id not in kept and bears:
                    kept.add(r.id)
                    needed += r.body
            for r in self.plain:
                if r.id not in plain and any(R.may_match(h, g) for h in r.head for g in needed):
                    plain.add(r.id)
                    needed += r.body
            if len(kept) + len(plain) == before:
                return kept


def bgp_free(p: tuple) -> tuple:
    """Predicates of patterns that look into whole graphs: those that quote one."""
    return (p[1],) if any(isinstance(t, str) and t.startswith("F") for t in (p[0], p[2])) else ()


def run_policy(graph: Graph, documents: list[n3.Document], filter_properties: tuple[str, ...] = COMPLIANCE, most_rounds: int = 200, goals: list[tuple] | None = None) -> tuple[DataFrame, DataFrame]:
    """(conclusions s, p, o with one of the filter properties; justifications of all assertions). With goals, patterns of
    statements, only rules that may bear on one of them run, and goals without variables end the run when all hold."""
    session, spark = graph.session, graph.spark
    policies = Policies(session, documents)
    for uri in [o[1:-1] for d in graph.documents for _, p, o in d.root.statements if p == air("please-import")]:
        policies.add(session.document(urljoin(policies.base, uri)))
    facts = written(graph.quads.where("g = ''").distinct(), "facts")
    relevant = None if goals is None else policies.towards(goals)
    active: dict[str, DataFrame] = {r: bgp.one_row(spark) for r in policies.top if relevant is None or r in relevant}
    inherited: dict[str, set[str]] = {r: set() for r in policies.top}
    fired: dict[str, DataFrame] = {}
    done_then: dict[str, DataFrame] = {}
    notes: list[DataFrame] = []
    # Notes go to tables, so that a row is not computed again.

    def bindings(r: AirRule) -> DataFrame:
        here = Graph(session, facts, graph.documents or documents, graph.prefixes)
        formulas = R.Rule(r.body, [], r.id, session.formulas)
        return bgp.solve(spark, r.body, lambda i: facts, start=active[r.id], graph_builtins=here.builtins(facts, formulas))

    def act(r: AirRule, actions: list[Action], rows: DataFrame, branch: str) -> tuple[DataFrame | None, bool]:
        """New facts of the actions, and whether a rule has been activated for new rows."""
        found, moved = None, False
        for a in actions:
            if a.kind == "assert":
                rule = R.Rule([], session.formulas[a.target[1:]].statements, r.id + a.target, session.formulas)
                note(r, rule, rows, branch, a)
                part = R.conclude(rows, rule)
                found = part if found is None else found.unionByName(part)
            elif a.kind == "rule":
                if relevant is None or a.target in relevant:
                    moved |= activate(a.target, rows)
            elif a.kind == "import":
                addresses = [a.target] if not T.is_var(a.target) else [x[0] for x in rows.select(F.col(f"`{name(a.target)}`")).distinct().collect()]
                for x in addresses:
                    for top in policies.add(session.document(urljoin(policies.base, x[1:-1]))):
                        moved |= activate(top, rows)
        return found, moved

    def activate(target: str, rows: DataFrame) -> bool:
        rule = policies.rule(target)
        keep = [c for c in rows.columns]
        rows = rows.select(*[F.col(f"`{c}`") for c in keep]).distinct() if keep else rows.limit(1)
        if target not in active:
            policies.check(rule, {"?" + c for c in keep})
            active[target], inherited[target] = written_rows(rows, keep), {"?" + c for c in keep}
            return not keep_empty(active[target], rows)
        if not keep:
            if active[target].isEmpty() and not rows.isEmpty():
                active[target] = bgp.one_row(spark)
                return True
            return False
        shared = [c for c in keep if c in active[target].columns]
        new = rows.select(*shared).distinct().join(active[target], shared, "left_anti") if shared else rows.limit(0)
        new = written(new, "activation") if shared else new
        if new.isEmpty():
            return False
        active[target] = written(active[target].select(*shared).unionByName(new), "active")
        return True

    def written_rows(rows: DataFrame, keep: list[str]) -> DataFrame:
        if keep:
            return written(rows, "active")
        return bgp.one_row(spark) if not rows.isEmpty() else spark.range(0).select()

    def keep_empty(now: DataFrame, rows: DataFrame) -> bool:
        return now.isEmpty()

    def note(r: AirRule, rule: R.Rule, rows: DataFrame, branch: str, a: Action) -> None:
        cols = rows.columns
        value = lambda t: bgp.column(t) if T.variables(t) <= {"?" + c for c in cols} else F.lit(str(t))
        told = F.concat_ws("", *[F.coalesce(T.c_text(value(t)), value(t)) for t in a.description]) if a.description else F.lit(None).cast("string")
        evidence = F.array(*[F.concat_ws(" ", *[value(t) for t in p]) for p in r.body if branch == "then" and not bgp.is_builtin(p)]) if branch == "then" else F.array(F.lit("closed world"))
        bound = F.create_map(*[x for c in cols for x in (F.lit(c), F.col(f"`{c}`"))]) if cols else F.create_map().cast("map<string,string>")
        heads = F.array(*[F.struct(*[value(t).alias(c) for c, t in zip("spo", st)]) for st in rule.head])
        out = rows.select(F.explode(heads).alias("x"), F.lit(r.id).alias("rule"), F.lit(branch).alias("branch"), F.lit(r.label).alias("label"), F.lit(r.hidden).alias("hidden"), F.lit(r.elided).alias("elided"), told.alias("description"), bound.alias("bindings"), evidence.cast("array<string>").alias("antecedents"))
        notes.append(written(out.select("x.s", "x.p", "x.o", *[c for c in out.columns if c != "x"]), "notes"))

    def learn(found: list[DataFrame]) -> bool:
        nonlocal facts
        found = [f for f in found if f is not None]
        if not found:
            return False
        new = found[0]
        for f in found[1:]:
            new = new.unionByName(f)
        new = written(new.distinct().join(facts, ["g", "s", "p", "o"], "left_anti"), "learned")
        if new.isEmpty():
            return False
        facts = written(facts.unionByName(new), "facts")
        return True

    def fresh(table: dict[str, DataFrame], key: str, rows: DataFrame) -> DataFrame:
        """Rows that have not been acted on, remembered from now on."""
        cols = rows.columns
        if key in table:
            old = table[key]
            rows = rows.join(old, cols, "left_anti") if cols else (rows.limit(0) if not old.isEmpty() else rows.limit(1))
        rows = written(rows.distinct(), "rows") if cols else (bgp.one_row(spark) if not rows.isEmpty() else spark.range(0).select())
        table[key] = rows if key not in table else (written(table[key].unionByName(rows), "done") if cols else (rows if not rows.isEmpty() else table[key]))
        return rows

    def reached() -> bool:
        if not goals or any(T.variables(t) for g in goals for t in g):
            return False
        rows = spark.createDataFrame([tuple(g) for g in goals], "s string, p string, o string")
        return rows.join(facts, ["s", "p", "o"], "left_anti").isEmpty()

    for r in policies.top:
        policies.check(policies.rules[r], set())
    for _ in range(most_rounds):
        if reached():
            break
        moved = False
        found: list[DataFrame] = []
        if policies.plain:
            found.append(R.think(facts, policies.plain, graph.builtins))
        for rid in list(active):
            r = policies.rules[rid]
            if not r.then:
                continue
            rows = fresh(done_then, rid, bindings(r))
            if rows.isEmpty():
                continue
            new, went = act(r, r.then, rows, "then")
            found.append(new)
            moved |= went
        if learn(found) or moved:
            continue
        # Closed world: nothing positive is left.
        found = []
        for rid in list(active):
            r = policies.rules[rid]
            if not r.otherwise:
                continue
            matched = bindings(r)
            cols = active[rid].columns
            rows = active[rid].join(matched.select(*cols).distinct(), cols, "left_anti") if cols else (active[rid].limit(0) if not matched.isEmpty() else active[rid])
            rows = fresh(fired, rid, rows)
            if rows.isEmpty():
                continue
            new, went = act(r, r.otherwise, rows, "else")
            found.append(new)
            moved |= went
        if not learn(found) and not moved:
            break
    else:
        raise RuntimeError(f"no end in {most_rounds} rounds")
    trace = spark.createDataFrame([], JUSTIFICATIONS)
    for n in notes:
        trace = trace.unionByName(n)
    wanted = [p if p.startswith("<") else T.iri(p) for p in filter_properties]
    return facts.where(F.col("p").isin(*wanted)).select("s", "p", "o").distinct(), trace.dropDuplicates([c for c in trace.columns if c != "bindings"])


def trace_graph(justifications: DataFrame) -> DataFrame:
    """The justifications as quads: for each a rule application, with the rule, its branch, the statement that it gives (a
    graph of its own), the statements that it depends on or that the world was closed, and its description; hidden ones
    are left out, and of elided ones only what they assert and describe stays."""
    shown = justifications.where("NOT hidden")
    me = F.md5(F.concat_ws("\u0001", "s", "p", "o", "rule", "branch", F.concat_ws("\u0002", "antecedents")))
    rows = shown.select("*", me.alias("me")).dropDuplicates(["me"])
    node, given = F.concat(F.lit("_:applied"), "me"), F.concat(F.lit("asserted"), "me")
    term = lambda local: F.lit(f"<{AIRJ}{local}>")
    quad = lambda s, p, o, g=F.lit(""): F.struct(g.alias("g"), s.alias("s"), p.alias("p"), o.alias("o"))
    open_ = ~F.col("elided")
    closed, otherwise = F.lit("_:closedWorld"), F.col("branch") != "then"
    quads = F.array(
        quad(node, F.lit(T.TYPE), term("RuleApplication")),
        quad(node, F.when(open_, F.lit(air("rule"))), F.col("rule")),
        quad(node, F.when(open_, term("branch")), F.when(otherwise, air("else")).otherwise(air("then"))),
        quad(node, term("asserts"), F.concat(F.lit("F"), given)),
        quad(F.col("s"), F.col("p"), F.col("o"), given),
        quad(node, F.when(otherwise & open_, term("flowDependency")), closed),
        quad(closed, F.when(otherwise & open_, F.lit(T.TYPE)), term("ClosingTheWorld")),
        quad(node, F.lit(air("description")), T.c_lit(F.col("description"))),
    )
    flat = rows.select(F.inline(quads))
    evidence = rows.where("NOT elided AND branch = 'then'").select("me", F.explode("antecedents").alias("used"))
    flat = flat.unionByName(evidence.select(F.lit("").alias("g"), node.alias("s"), term("dataDependency").alias("p"), T.c_lit(F.col("used")).alias("o")))
    return flat.where("p IS NOT NULL AND o IS NOT NULL").distinct()


def nested_run(graph: Graph, parts: list[list[str]]) -> str:
    """air:justifies: (logs, rules[, properties]) run as a policy of their own; the formula of its conclusions."""
    s = graph.session
    logs, rules = parts[0], parts[1]
    statements = [st for f in logs for st in s.formulas[f[1:]].statements]
    gid = s.keep("log_" + digest(logs), statements)
    doc = n3.Document(graph.documents[0].base if graph.documents else "", s.formulas | {"": n3.Formula([st for f in rules for st in s.formulas[f[1:]].statements])}, {})
    from gossamer.plans.graphs import rows_of

    properties = tuple(parts[2]) if len(parts) > 2 else COMPLIANCE
    out, _ = run_policy(Graph(s, rows_of(s, gid)), [doc], properties)
    return s.keep("run_" + digest([*logs, *rules, *properties]), [(r.s, r.p, r.o) for r in out.collect()])


def run_texts(session: Session, facts: list[str], rules: list[str], filter_properties: tuple[str, ...] = COMPLIANCE) -> tuple[DataFrame, DataFrame]:
    """The same from addresses of documents."""
    docs = [session.document(u) for u in rules]
    graph = session.load(*facts) if facts else Graph(session, R.empty(session.spark), [])
    return run_policy(graph, docs, filter_properties)
