"""Input relations. Extractors write their facts in these columns (a bare name is a symbol, a trailing # marks a number)."""

from __future__ import annotations

STATIC = """
SqlNamingViolation file line# table column kind
SqlMigrationOrderViolation file line# fromTable fromCol toTable fkMig# targetMig#
TruthPointWriter concept file
TruthPointReader concept file
TestedFile file
DriftSignalFact file line# kind
CoChange fileA fileB count# jaccardX100#
ResourceImbalance file line# containingSymbol pair acquireCount# releaseCount#
TaintSink file line# kind callee containingSymbol
SanitizerCall file line# callee containingSymbol
TaintedVarDecl file containingSymbol varName line# source
TaintedArgCall file line# callee argVarName argIndex# source containingSymbol
TaintedArgumentToCall callerFile callerSymbol callee paramIndex# source
FunctionParam file symbol paramName paramIndex#
ModuleCentrality file pageRank# henryKafura#
FsmStateDeclared concept state
FsmStateOrphan concept state confidence
BackEdge fromGroup toGroup
File file
FileTag file tag
UnusedExport file name line# kind confidence
LongFunction file name line# locCount#
MagicNumber file line# value context category
Barrel file reExportCount# consumerCount# lowValue
PackageDepIssue packageName packageJson kind declaredIn
IsPackageEntryPoint file
IsFrameworkConventionFile file
Imports from to
ImportEdge from to line#
EmitsLiteral file line# eventName
EmitsConstRef file line# namespace member
EmitsDynamic file line#
EnvRead file line# varName hasDefault
EnvReadWrapped file line# varName wrappedIn
OauthScopeLiteral file line# scope
ModuleFanIn file count#
CycleNode file cycleId gated
CycleSize cycleId size# sccSize#
SymbolCallEdge fromFile fromSymbol toFile toSymbol line#
SymbolSignature file name kind line#
EntryPoint file kind id
EvalCall file line# kind containingSymbol
CryptoCall file line# fn algo containingSymbol
HardcodedSecret file line# context trigger entropy#
SecretVarRef file line# varName kind callee containingSymbol
CorsConfig file line# originKind containingSymbol
TlsConfigUnsafe file line# key containingSymbol
WeakRandomCall file line# varName secretKind containingSymbol
ListensLiteral file line# eventName
ListensConstRef file line# namespace member
ListensDynamic file line#
SqlTable name file line#
SqlColumn table column type file line#
SqlForeignKey fromTable fromCol toTable toCol file line#
SqlIndex name table firstCol file line#
SqlFkWithoutIndex fromTable fromCol toTable toCol
SqlPrimaryKey table column file line#
BooleanParam file line# name paramName paramIndex# totalParams#
FloatingPromise file line# callee containingSymbol
DeadCode file line# kind
DeprecatedDecl name file line#
DeprecatedUsage file line# callee
ArticulationPoint file severity#
ConstantExpression kind file line# exprRepr
EslintViolation file line# ruleId severity#
RegexLiteral file line# source flags hasNestedQuantifier
TryCatchSwallow file line# kind containingSymbol
AwaitInLoop file line# loopKind containingSymbol
AllocationInLoop file line# allocKind containingSymbol
FunctionComplexity file name line# cyclomatic# cognitive# containingClass
SpectralMetric scope nodeCount# edgeCount# fiedlerX1000# cheegerBound#
SymbolEntropy fromSymbol callCount# distinctCallees# entropyX1000#
PackageMinCut fromPackage toPackage edgeCount# minCut#
InformationBottleneck symbol callerCount# calleeCount# scoreX1000#
SymbolFile symbol file
SignatureNearDuplicate symbolA symbolB hamming#
PersistentCycle cycleId snapshotCount# totalSnapshots# persistenceX1000# gated
LyapunovMetric file totalCoChanges# partnerCount# lyapunovX1000#
CompressionDistance symbolA symbolB ncdX1000#
ImportCommunity file communityId# physicalPackage misplaced#
ModularityScore globalQX1000# communityCount# misplacedCount#
FactKindStability relationName snapshotsTotal# stableTransitions# stationaryStableX1000# avgTupleCount#
BayesianCoChange driver follower conditionalProbX1000#
GrangerCausality driverFile followerFile observations# excessConditionalX1000#
DocStaleClaim file line# kind target issue
"""

RUNTIME = """
SymbolTouchedRuntime file fn count# p95LatencyMs#
HttpRouteHit method routePath status# count# p95LatencyMs#
DbQueryExecuted tableName op count# lastAtUnix#
RedisOpExecuted op keyPattern count#
EventEmittedAtRuntime eventType count# lastAtUnix#
CallEdgeRuntime fromFile fromFn toFile toFn count#
RuntimeRunMeta driver startedAtUnix# durationMs# totalSpans# bucketSizeMs# bucketCount#
LatencySeries kind seriesKey bucketIdx# eventCount# meanLatencyMs#
HammingStaticRuntime distancePermille# staticOnly# runtimeOnly# total#
IBScoreRuntime file fn inflow# outflow# scorePermille#
NgGlobalQ qPermille#
NgFileQ file qPermille# symbolsCount#
LyapunovRuntime file fn p95LatencyMs# count# lambdaPermille#
GrangerRuntime driverSeries followerSeries observations# excessConditionalX1000# lagBuckets#
GrangerRuntimeFile driverFile followerFile observations# maxExcessX1000#
LyapunovTimeseries kind seriesKey observations# stdDevX1000# lambdaX1000#
PersistentComponent rep birthCount# deathCount# persistence# componentSize#
RuntimeRouteExpected method routePath
"""


def relations(text: str) -> dict[str, list[tuple[str, str]]]:
    """name -> (column, type) in order."""
    out = {}
    for line in text.split("\n"):
        name, *columns = line.split() or [""]
        if name:
            out[name] = [(c.rstrip("#"), "number" if c.endswith("#") else "symbol") for c in columns]
    return out


def declarations(text: str, only: set[str] | None = None) -> str:
    """``.decl`` and ``.input`` lines, of all relations or of those named."""
    return "".join(f".decl {name}({', '.join(f'{c}: {k}' for c, k in columns)})\n.input {name}\n" for name, columns in relations(text).items() if only is None or name in only)
