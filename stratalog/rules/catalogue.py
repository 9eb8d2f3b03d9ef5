"""Tables of checks for ``checks.violations``. Names, columns, thresholds and word lists are fixed values that reports and baselines rely on."""

from __future__ import annotations

from .checks import Check, Context


def among(column: str, words: str) -> str:
    """SQL: the column is one of the words."""
    return f"{column} in ({', '.join(repr(w) for w in words.split())})"


# Words that checks look for.
LOGGERS = (
    "logger.info logger.warn logger.error logger.debug logger.log logger.trace logger.fatal log.info log.warn log.error log.debug log.trace "
    "console.log console.info console.warn console.error console.debug pino.info winston.info"
)
WEAK_HASHES = "md5 md4 md2 sha1 sha-1 ripemd128"
WEAK_CIPHERS = "des des-ede des-ede3 rc4 rc2 aes-128-ecb aes-192-ecb aes-256-ecb"
PLAIN_TIMESTAMPS = ["TIMESTAMP", "timestamp", "TIMESTAMP WITHOUT TIME ZONE", "timestamp without time zone"]
ALLOWED_ENV = "NODE_ENV NODE_OPTIONS NODE_PATH NODE_DEBUG"
GUARDS = {
    "path": "normalize resolve path.normalize path.resolve",
    "shell": "shellEscape shell-escape shell.escape",
    "html": "escape escapeHtml sanitizeHtml sanitize encode encodeURIComponent DOMPurify.sanitize",
    "sql": "validateBody validateQuery validateParams parse safeParse",
    "merge": "validateBody validateSchema parse safeParse",
    "shape": "validateBody validateSchema validateInput safeParse",
    "url": "validateUrl isAllowedUrl checkUrl isInternalIp validateBody parse",
}
MERGERS = "assign merge mergeWith extend defaults defaultsDeep set"
DESERIALIZERS = "load deserialize unserialize loadAll parseXml parse"

CONTEXTS: dict[str, Context] = {
    # a file's place in the graph
    "cut-file": Context("ArticulationPoint", ("file",)),
    "cycle": Context("CycleNode", ("file",)),
    "imported": Context("Imports", ("to",)),
    "entry": Context("EntryPoint", ("file",)),
    "route": Context("EntryPoint", ("file",), "kind = 'http-route'"),
    "package-entry": Context("IsPackageEntryPoint", ("file",)),
    "convention": Context("IsFrameworkConventionFile", ("file",)),
    "known-file": Context("File", ("file",)),
    **{f"fan-in-{n}": Context("ModuleFanIn", ("file",), f"count >= {n}") for n in (5, 10, 20)},
    **{f"rank-{n}": Context("ModuleCentrality", ("file",), f"pageRank > {n}") for n in (5, 200, 500)},
    **{tag: Context("FileTag", ("file",), f"tag = '{tag}'") for tag in ("test", "test-fixture", "framework-routed", "api")},
    # what else is known of it
    "tested": Context("TestedFile", ("file",)),
    "writer": Context("TruthPointWriter", ("file",)),
    "config": Context("IsConfigFile", ("file",)),
    "unstable": Context("LyapunovMetric", ("file",), "lyapunovX1000 > 1500"),
    "changing": Context("CoChange", ("fileA",), "count >= 3"),
    "clear-modules": Context("ModularityScore", (), "globalQX1000 > 300"),
    "standing-cycle": Context("PersistentCycle", ("cycleId",), "gated = 'false'"),
    "swallows": Context("TryCatchSwallow", ("file",), "kind = 'empty'"),
    "sinks": Context("TaintSink", ("file",)),
    "complex-8": Context("FunctionComplexity", ("file", "name"), "cyclomatic > 8"),
    "awaiting": Context("AwaitInLoop", ("file", "containingSymbol")),
    "boolean-switch": Context("BooleanParam", ("file", "line")),
    # data from outside
    "tainted-here": Context("TaintedArgCall", ("file", "line")),
    "tainted-from-outside": Context("TaintedArgCall", ("file", "line"), "source != 'process.env'"),
    "tainted-symbol": Context("TaintedSymbol", ("symbol",)),
    "guarded": Context("SanitizerCall", ("file",)),
    **{f"guard-{k}": Context("SanitizerCall", ("file",), among("callee", v)) for k, v in GUARDS.items()},
    # shared state, events and tables
    "read": Context("TruthPointReader", ("concept",)),
    "listened": Context("ListensLiteral", ("eventName",)),
    "table": Context("SqlTable", ("name",)),
    "keyed": Context("SqlPrimaryKey", ("table",)),
    "unindexed": Context("SqlFkWithoutIndex", ("fromTable", "fromCol")),
    "managed": Context("IsManagedTable", ("name",)),
    # what a run has shown
    "ran": Context("SymbolTouchedRuntime", ("file", "fn")),
    "any-run": Context("SymbolTouchedRuntime"),
    "hit": Context("HttpRouteHit", ("method", "routePath")),
    "any-hit": Context("HttpRouteHit"),
    "queried": Context("DbQueryExecuted", ("tableName",)),
    "any-query": Context("DbQueryExecuted"),
    "called": Context("SymbolCallEdge", ("toFile", "toSymbol")),
    "import-target": Context("ImportEdge", ("to",)),
    "back-and-forth": Context("RuntimeMutual", ("file",)),
    "ten-files": Context("RuntimeFiles", (), "n >= 10"),
}


def _family(relation: str, rows: str) -> list[Check]:
    """Checks over one relation; a line is: name | condition | contexts, an exclamation mark before those to be absent | place | detail | number."""
    out = []
    for line in filter(None, map(str.strip, rows.split("\n"))):
        name, where, uses, place, detail, number = (*(x.strip() for x in line.split("|")), *[""] * 6)[:6]
        uses = uses.split()
        out.append(Check(name, relation, where or "true", tuple(u for u in uses if u[0] != "!"), tuple(u[1:] for u in uses if u[0] == "!"), place, detail, number))
    return out


#: Checks of source structure.
STATIC: list[Check] = [
    *_family("ArticulationPoint", """
        NO-NEW-ARTICULATION-POINT | | !package-entry !convention
        COMPOSITE-HIGH-CRITICAL-UNTESTED | | writer !tested"""),
    *_family("ModuleFanIn", """
        COMPOSITE-HUB-UNTESTED | count >= 20 | !tested
        COMPOSITE-FANOUT-NO-TEST-NO-ARTIC | count > 15 | !tested !cut-file"""),
    *_family("CycleNode", "CYCLES | gated = 'false' | | file | cycleId"),
    *_family("CycleSize", "COMPOSITE-NESTED-CYCLE | sccSize > size"),
    *_family("PersistentCycle", "COMPOSITE-STRUCTURAL-CYCLE-PERSISTENT | persistenceX1000 > 500 and gated = 'false'"),
    *_family("BackEdge", "COMPOSITE-BACK-EDGE | | | fromGroup | toGroup"),
    *_family("Barrel", "COMPOSITE-BARREL-LOW-VALUE | lowValue = 'true' | !package-entry"),
    *_family("File", "COMPOSITE-ORPHAN-FILE | | !imported !entry !package-entry !framework-routed !test-fixture"),
    *_family("FanOut", "COMPOSITE-FANOUT-OVERLOAD | n > 25"),
    *_family("ImportCommunity", "COMPOSITE-MISPLACED-FILE | misplaced = 1 | clear-modules !convention"),
    *_family("PackageMinCut", "COMPOSITE-PACKAGE-COUPLING | minCut > 5 | | fromPackage | toPackage"),
    *_family("SpectralMetric", "COMPOSITE-SPECTRAL-BOTTLENECK | nodeCount >= 5 and fiedlerX1000 < 50"),
    *_family("FloatingPromise", """
        NO-FLOATING-PROMISE
        COMPOSITE-ARTICULATION-WITH-FLOATING-PROMISE | | cut-file"""),
    *_family("EslintViolation", """
        COMPOSITE-ESLINT-IN-ARTICULATION | severity = 2 | cut-file
        COMPOSITE-ESLINT-IN-UNTESTED-CYCLE | | cycle !tested"""),
    *_family("UnusedExport", """
        COMPOSITE-DEAD-EXPORT-IN-HUB | confidence = 'safe-to-remove' | fan-in-10 | file | name
        META-COMPOSITE-DEAD-COMPLEX-CODE | confidence = 'safe-to-remove' | complex-8:file,name | file | name"""),
    *_family("BayesianCoChange", "COMPOSITE-BAYESIAN-DRIVER | conditionalProbX1000 >= 800 | !convention:driver !convention:follower | driver | follower"),
    *_family("LyapunovMetric", """
        COMPOSITE-CHAOS-AMPLIFIER | lyapunovX1000 > 2000 | known-file !test-fixture
        META-COMPOSITE-CRITICAL-INSTABILITY | lyapunovX1000 > 1500 | rank-5 !tested !convention"""),
    *_family("CoChange", "COMPOSITE-COCHANGE-WITHOUT-COTEST | count >= 5 and jaccardX100 >= 30 | tested:fileA known-file:fileB !tested:fileB !test-fixture:fileB | fileB | fileA"),
    *_family("GrangerCausality", "COMPOSITE-GRANGER-DRIVER | excessConditionalX1000 >= 500 | | driverFile | followerFile"),
    *_family("FactKindStability", "COMPOSITE-VOLATILE-RELATION | snapshotsTotal >= 10 and stationaryStableX1000 < 400 and avgTupleCount >= 5"),
    *_family("SignatureNearDuplicate", """
        COMPOSITE-COPY-PASTE-FORK | hamming = 0 | | symbolA | symbolB"""),
    *_family("CompressionDistance", "COMPOSITE-NEAR-DUPLICATE-FN | ncdX1000 < 300 | | symbolA | symbolB"),
    *_family("FunctionComplexity", """
        COMPOSITE-COGNITIVE-BOMB | cognitive > 25 | | file | name
        COMPOSITE-CYCLOMATIC-BOMB | cyclomatic > 15 | | file | name
        COMPOSITE-CRITICAL-REFACTOR | cyclomatic > 10 | rank-500 !tested | file | name"""),
    *_family("ConstantExpression", """
        COMPOSITE-DEAD-BRANCH-IN-HUB | kind in ('tautology-condition', 'contradiction-condition') | fan-in-5
        COMPOSITE-TAUTOLOGY-IN-TRUTH-POINT | kind in ('tautology-condition', 'contradiction-condition') | writer
        COMPOSITE-TAUTOLOGY-RECENT-COCHANGE | kind in ('tautology-condition', 'contradiction-condition') | changing
        COMPOSITE-GRATUITOUS-BOOL-UNTESTED-HUB | kind = 'gratuitous-bool-comparison' | fan-in-5 !tested"""),
    *_family("DriftSignalFact", """
        COMPOSITE-TODO-IN-TRUTH-POINT-WRITER | kind = 'todo-no-owner' | writer
        COMPOSITE-DOUBLE-DRIFT-WRAPPER-BOOLEAN | kind = 'wrapper-superfluous' | boolean-switch:file,line"""),
    *_family("DriftCount", "COMPOSITE-DRIFT-SIGNAL-DENSITY | n > 2"),
    *_family("SymbolEntropy", "COMPOSITE-GOD-DISPATCHER | entropyX1000 > 4000 and distinctCallees >= 10"),
    *_family("CallCount", "COMPOSITE-GOD-FUNCTION | n > 30 | | toFile | toSymbol"),
    *_family("InformationBottleneck", "COMPOSITE-INFORMATION-HUB-UNTESTED | scoreX1000 > 25000"),
    *_family("AllocationInLoop", "COMPOSITE-HOT-ALLOCATION | | awaiting:file,containingSymbol rank-200"),
    *_family("AwaitInLoop", """
        COMPOSITE-AWAIT-IN-LOOP | | !convention
        COMPOSITE-ASYNC-SINK-WITH-SWALLOW | | sinks swallows | file | | 0"""),
    *_family("FunctionParam", "COMPOSITE-LONG-FUNCTION-BY-PARAMS | paramIndex >= 6 | | file | symbol | 0"),
    *_family("BooleanParam", """
        NO-BOOLEAN-POSITIONAL-PARAM | | | file | name
        COMPOSITE-BOOLEAN-TRAP-UNTESTED | | !tested | file | name"""),
    *_family("DeadCode", """
        NO-CONTROLLING-EXPRESSION-CONSTANT | kind = 'controlling-expression-constant'
        NO-IDENTICAL-SUBEXPRESSIONS | kind = 'identical-subexpressions'
        NO-RETURN-THEN-ELSE | kind = 'return-then-else'
        NO-SWITCH-EMPTY-OR-NO-DEFAULT | kind in ('switch-empty', 'switch-no-default')
        NO-SWITCH-FALLTHROUGH | kind = 'switch-fallthrough'"""),
    *_family("DeprecatedUsage", """
        NO-DEPRECATED-USAGE
        COMPOSITE-DEPRECATED-ON-TRUTH-POINT-WRITER | | writer"""),
    *_family("ResourceImbalance", "NO-RESOURCE-IMBALANCE | | | file | containingSymbol"),
    *_family("TryCatchSwallow", "COMPOSITE-SILENT-ERROR | kind = 'empty'"),
    *_family("MagicNumber", "COMPOSITE-MAGIC-IN-CONFIG | | config"),
    *_family("LongFunction", "COMPOSITE-LONG-FN-IN-TRUTH-POINT-WRITER | locCount >= 80 | writer | file | name"),
    *_family("TruthPointWriter", "COMPOSITE-TRUTH-POINT-ASYMMETRIC | | !read:concept | file | concept"),
    *_family("ReadCount", "COMPOSITE-TRUTH-POINT-GOD-READER | n > 5"),
    *_family("FsmStateOrphan", "COMPOSITE-FSM-ORPHAN | confidence = 'observed' | | concept | state"),
    *_family("EmitsLiteral", "COMPOSITE-EVENT-ORPHAN | | !listened:eventName !test-fixture | file | eventName"),
    *_family("EnvCount", f"COMPOSITE-ENV-VAR-SPREAD | n > 2 and not {among('varName', ALLOWED_ENV)}"),
    *_family("PackageDepIssue", "COMPOSITE-DEP-UNUSED | kind = 'declared-unused' | | packageJson | packageName"),
    # security
    *_family("SecretVarRef", f"COMPOSITE-CLEAR-TEXT-LOGGING | {among('callee', LOGGERS)}"),
    *_family("CorsConfig", "COMPOSITE-CORS-MISCONFIG | originKind in ('wildcard', 'reflective') | | file | originKind"),
    *_family("TlsConfigUnsafe", "COMPOSITE-DISABLING-CERT-VALIDATION"),
    *_family("WeakRandomCall", "COMPOSITE-INSECURE-RANDOMNESS | secretKind != '_'"),
    *_family("RegexLiteral", "COMPOSITE-REDOS | hasNestedQuantifier = 'true'"),
    *_family("CryptoCall", f"COMPOSITE-WEAK-CRYPTO-ALGO | {among('algo', WEAK_HASHES + ' ' + WEAK_CIPHERS)} | | file | algo"),
    *_family("EvalCall", """
        NO-EVAL | | | file | kind
        COMPOSITE-EVAL-IN-HTTP-ROUTE | | route"""),
    *_family("TaintSink", """
        CWE-022 | kind in ('fs-read', 'fs-write') | tainted-here:file,line !guard-path
        CWE-078 | kind = 'exec' | tainted-here:file,line !guard-shell
        CWE-079 | kind = 'html-out' | tainted-here:file,line !guard-html
        CWE-089 | kind = 'sql' | tainted-here:file,line !guard-sql
        CWE-918 | kind = 'http-out' | tainted-from-outside:file,line !guard-url
        COMPOSITE-TAINTED-VAR-TO-SINK | | tainted-from-outside:file,line
        COMPOSITE-CROSS-FUNCTION-TAINT | | tainted-symbol:containingSymbol
        COMPOSITE-CROSS-FN-CMD-INJECTION | kind = 'exec' | tainted-symbol:containingSymbol !guard-shell
        COMPOSITE-CROSS-FN-LOG-INJECTION | kind = 'log' | tainted-symbol:containingSymbol
        COMPOSITE-CROSS-FN-PATH-TRAVERSAL | kind in ('fs-read', 'fs-write') | tainted-symbol:containingSymbol !guard-path
        COMPOSITE-CROSS-FN-REDIRECT | kind = 'redirect' | tainted-symbol:containingSymbol
        COMPOSITE-CROSS-FN-SQLI | kind = 'sql' | tainted-symbol:containingSymbol !guard-sql"""),
    *_family("TaintedArgCall", f"""
        CWE-1321 | {among('callee', MERGERS)} | !guard-merge
        CWE-327 | callee in ('md5', 'sha1')
        CWE-502 | {among('callee', DESERIALIZERS)} | !guard-shape"""),
    # documents and databases
    *_family("DocStaleClaim", "\n".join(f"COMPOSITE-DOC-STALE-{n} | kind in ({k}) | | file | target" for n, k in (("RULE", "'rule-mention', 'frontmatter-rule'"), ("FILE", "'file-ref', 'frontmatter-file'"), ("ADR", "'adr-ref', 'frontmatter-adr'")))),
    *_family("ColumnCount", "COMPOSITE-FAT-TABLE | n > 25"),
    *_family("ReferenceCount", "COMPOSITE-GOD-TABLE | n > 10"),
    *_family("SqlForeignKey", """
        SQL-FK-INDEX | | unindexed:fromTable,fromCol | file | concat(fromTable, '.', fromCol)
        SQL-ORPHAN-FK | | !table:toTable !managed:toTable | file | concat(fromTable, '.', fromCol)"""),
    *_family("SqlNamingViolation", """
        SQL-AUDIT-COLUMNS | kind like 'audit-column-missing-%' | | file | `table`
        SQL-NAMING-CONVENTION | kind in ('table-not-snake-case', 'column-not-snake-case', 'timestamp-missing-at-suffix', 'fk-missing-id-suffix') | | file | kind"""),
    *_family("SqlMigrationOrderViolation", "SQL-MIGRATION-ORDER"),
    *_family("SqlTable", "SQL-TABLE-NEEDS-PK | | !keyed:name | file | name"),
    *_family("SqlColumn", f"SQL-TIMESTAMP-NEEDS-TZ | type in ({', '.join(map(repr, PLAIN_TIMESTAMPS))}) | | file | `column`"),
]

#: Checks of what a run has shown, by itself or beside the static facts.
RUNTIME: list[Check] = [
    *_family("IBScoreRuntime", """
        BOTTLENECK | inflow >= 5 and scorePermille > 850 | | file | fn | scorePermille
        COMPOSITE_HUB_BOTTLENECK | inflow >= 5 and scorePermille > 850 | fan-in-20 | file | fn | scorePermille"""),
    *_family("LyapunovRuntime", "CHAOTIC_LATENCY | count >= 10 and lambdaPermille > 6900 | | file | fn | lambdaPermille"),
    *_family("HammingStaticRuntime", "DRIFT_HIGH | total >= 50 and distancePermille > 300 | | 'global' | 'graph' | distancePermille"),
    *_family("NgGlobalQ", "MODULARITY_COLLAPSE | qPermille < 300 | ten-files | 'global' | 'graph' | qPermille"),
    *_family("SymbolTouchedRuntime", "HOT_PATH_UNTESTED | count >= 10 | !tested | file | fn | count"),
    *_family("CycleNode", "COMPOSITE_CYCLE_RUNTIME_CONFIRMED | | back-and-forth | file | cycleId | 0"),
    *_family("UnusedExport", "DEAD_HANDLER | kind in ('function', 'class') | import-target:file called:file,name !ran:file,name | file | name | 0"),
    *_family("StaticCallers", "RUNTIME_DRIFT | n >= 2 | any-run !ran:toFile,toSymbol | toFile | toSymbol | n"),
    *_family("RuntimeRouteExpected", "DEAD_ROUTE | | any-hit !hit:method,routePath | method | routePath"),
    *_family("TruthPointWriter", "STALE_QUERY | | any-query !queried:concept | concept | file"),
]

#: relation -> (relation it counts, columns counted by): derived before checks that read it.
COUNTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "DriftCount": ("DriftSignalFact", ("file",)),
    "EnvCount": ("EnvRead", ("varName",)),
    "FanOut": ("Imports", ("from",)),
    "ColumnCount": ("SqlColumn", ("table",)),
    "ReferenceCount": ("SqlForeignKey", ("toTable",)),
    "CallCount": ("SymbolCallEdge", ("toFile", "toSymbol")),
    "StaticCallers": ("SymbolCallEdge", ("toFile", "toSymbol")),
    "ReadCount": ("TruthPointReader", ("file",)),
    "RuntimeFiles": ("NgFileQ", ()),
}
