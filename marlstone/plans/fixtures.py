"""A corpus of SQL objects, one a customer, written for this library.

Objects are made of templates; §K stands for the customer's key and §N for its
nation's, so that objects differ and refer to each other as real ones do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATES = [
    """CREATE PROCEDURE [n§N].[Aging§K] @AsOf DATE, @Branch VARCHAR(10) = 'ALL' AS
BEGIN
SET NOCOUNT ON
DECLARE @Cut DATE = '2020-03-31'
-- UPDATE n§N.Accounts SET Bucket = 'OLD' WHERE Balance = 0;
UPDATE A SET A.DaysDue = DATEDIFF(DAY, A.DueDate, @AsOf), A.Fee = A.Balance * 0.02
FROM n§N.Accounts A
INNER JOIN n§N.Customers C ON A.CustomerId = C.CustomerId AND C.Active = 'Y'
WHERE A.Balance > §K AND NOT EXISTS (SELECT 1 FROM n§N.Closures Z WHERE Z.AccountId = A.AccountId)
UPDATE n§N.Accounts SET Bucket = CASE WHEN DaysDue > 90 THEN 'LATE3'
    WHEN DaysDue > 60 THEN CASE WHEN Secured = 1 THEN 'LATE2S' ELSE 'LATE2' END
    WHEN DaysDue > 0 THEN 'LATE1' ELSE 'CURRENT' END
SELECT AccountId, Balance INTO #Late FROM n§N.Accounts WHERE DaysDue > 90
INSERT INTO n§N.Watch (AccountId, Amount)
SELECT AccountId, Balance + Fee FROM n§N.Accounts WHERE Bucket = 'LATE3'
EXEC n§N.Notify @AsOf
END""",
    """CREATE PROCEDURE n§N.Settle§K AS
BEGIN TRY
MERGE n§N.Totals AS T
USING (SELECT CustomerId, SUM(Balance) AS Total FROM n§N.Accounts GROUP BY CustomerId) AS S
ON T.CustomerId = S.CustomerId
WHEN MATCHED AND T.Locked = 0 THEN
  UPDATE SET T.Total = T.Total + S.Total
WHEN NOT MATCHED THEN
  INSERT (CustomerId, Total) VALUES (S.CustomerId, S.Total);
DELETE FROM n§N.Watch WHERE AccountId IN (SELECT AccountId FROM n§N.Closures, n§N.Extra WHERE Id = §K);
TRUNCATE TABLE n§N.Scratch
END TRY
BEGIN CATCH
PRINT ERROR_MESSAGE()
END CATCH
GO
EXEC('SELECT 1')""",
    """CREATE OR REPLACE FUNCTION r§N.grade§K(p_id IN NUMBER, p_out OUT VARCHAR2) RETURN VARCHAR2 IS
v_days NUMBER; v_grade VARCHAR2(10);
BEGIN
SELECT NVL(days_due, 0) INTO v_days FROM r§N.accounts WHERE id = p_id;
IF v_days > 90 THEN v_grade := 'C';
ELSIF v_days > 30 THEN
  IF p_id = §K THEN v_grade := 'B1'; ELSE v_grade := 'B2'; END IF;
ELSE v_grade := 'A'; END IF;
RETURN v_grade;
EXCEPTION WHEN NO_DATA_FOUND THEN RETURN 'NONE';
END;""",
    "CREATE VIEW n§N.Open§K AS\nWITH big AS (SELECT CustomerId FROM n§N.Totals WHERE Total > §K)\nSELECT C.Name FROM n§N.Customers C LEFT JOIN big B ON B.CustomerId = C.CustomerId WHERE B.CustomerId IS NOT NULL",
    """CREATE PROCEDURE n§N.Tier§K @Score INT, @Out VARCHAR(10) OUTPUT
AS
IF @Score >= 90
    UPDATE n§N.[Staff Members] SET Tier = 'GOLD' WHERE Id = §K
ELSE IF @Score >= 70
    UPDATE n§N.[Staff Members] SET Tier = 'SILVER'
ELSE
BEGIN
    INSERT INTO n§N.Queue (StaffId, Note, Tier) SELECT x, (SELECT MAX(y) FROM n§N.Notes), 'NONE' FROM n§N.Work w, n§N.Rest
    SET @Out = 'BRONZE'
END
IF @Score = 0
BEGIN
    DELETE FROM n§N.Queue
END
INSERT INTO n§N.Log (Id, Note) VALUES (§K, CHOOSE(@Score, 'low', 'high'))""",
    """CREATE PROCEDURE n§N.MainRun§K AS
BEGIN
IF (SELECT Completed FROM n§N.RunningProcessStatus WHERE Name='StepA')='Y'
AND (SELECT Completed FROM n§N.RunningProcessStatus WHERE Name='StepB')='N'
BEGIN
    INSERT INTO n§N.ProcessMonitor(UserID,Description,MODE)
    SELECT ORIGINAL_LOGIN(),'StepB','RUNNING'
    EXEC n§N.StepB @TIMEKEY=§K
END

IF (SELECT Completed FROM n§N.RunningProcessStatus WHERE Name='StepB')='N'
BEGIN
  RETURN;
END
ELSE
BEGIN
    UPDATE n§N.AuditStatus SET CompletedCount=CompletedCount+1
END

IF (SELECT Completed FROM n§N.RunningProcessStatus WHERE Name='StepB')<>'N'
BEGIN
    EXEC n§N.Settle@ @TIMEKEY=§K
END
END""".replace("Settle@", "Settle7"),
]


def objects(customers: DataFrame) -> DataFrame:
    """object_id, code; dealt to all cores first, as code is long to read."""
    customers = customers.select("c_custkey", "c_nationkey").repartition(customers.sparkSession.sparkContext.defaultParallelism, "c_custkey")
    template = F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("c_custkey") % len(TEMPLATES)).cast("int"))
    filled = F.replace(F.replace(template, F.lit("§K"), F.col("c_custkey").cast("string")), F.lit("§N"), F.col("c_nationkey").cast("string"))
    return customers.select(F.col("c_custkey").alias("object_id"), filled.alias("code"))


def expected(columns: str, rows: list[tuple], places: str = "") -> str:
    """SQL of hand-written rows (template, values ..) for each object.

    Texts may have the marks of templates.  ``places`` are extra conditions.
    """
    names = columns.split()

    def literal(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        if isinstance(x, (list, tuple)):
            return "[" + ", ".join(map(literal, x)) + "]" if x else "CAST([] AS VARCHAR[])"
        return "NULL" if x is None else str(x)

    def shown(i: int, name: str) -> str:
        values = [row[i + 1] for row in rows if row[i + 1] is not None]
        put = "replace(replace({0}, '§K', CAST(c_custkey AS VARCHAR)), '§N', CAST(c_nationkey AS VARCHAR))"
        if values and isinstance(values[0], str):
            return f"{put.format(f'v.{chr(34)}{name}{chr(34)}')} AS \"{name}\""
        if values and isinstance(values[0], (list, tuple)):
            return f'list_transform(v."{name}", lambda x: {put.format("x")}) AS "{name}"'
        return f'v."{name}"'

    values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows)
    return f"SELECT c_custkey AS object_id, {', '.join(shown(i, n) for i, n in enumerate(names))} FROM customer JOIN (VALUES {values}) v(template, {', '.join(f'"{n}"' for n in names)}) ON c_custkey % {len(TEMPLATES)} = v.template {places}"
