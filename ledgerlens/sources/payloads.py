"""Schemas of landed API payloads (one JSON object per line)."""

from __future__ import annotations

from pyspark.sql import types as T


FORMULA_SEARCH = """
    id BIGINT, name STRING, owner BIGINT,
    links ARRAY<STRUCT<active: BOOLEAN, resource: STRUCT<type: STRING, id: STRING>>>
"""
FORMULA_DETAIL = "id BIGINT, expression STRING, legacyId STRING, columnPositions ARRAY<STRING>"
CARD_SUMMARY = """
    id STRING, title STRING, type STRING,
    pageHierarchy ARRAY<STRUCT<pageId: BIGINT, title: STRING>>,
    owners ARRAY<STRUCT<displayName: STRING>>
"""
CARD_INFO = """
    id STRING, viewInfo STRUCT<totalViewCount: BIGINT, lastViewedDate: BIGINT>,
    datasources ARRAY<STRUCT<dataSourceId: STRING, dataSourceName: STRING>>
"""
DATASET_SEARCH = """
    id STRING, name STRING, rowCount BIGINT, columnCount INT, cardInfo STRUCT<cardCount: INT>,
    dataFlowCount INT, dataProviderType STRING, type STRING, streamId STRING,
    scheduleActive BOOLEAN, status STRING, state STRING, lastUpdated BIGINT
"""
DATASET_DETAIL = """
    id STRING, name STRING, dataProvider STRUCT<type: STRING, name: STRING>, displayType STRING,
    type STRING, dataProviderType STRING, rowCount BIGINT, columnCount INT, cardCount INT,
    dataFlowCount INT, streamId STRING, scheduleActive BOOLEAN, status STRING, state STRING,
    lastUpdated BIGINT
"""
DATAFLOW_STUB = """
    databaseId STRING, name STRING, ownedByName STRING, status STRING, paused BOOLEAN,
    dataFlowType STRING, executionCount INT,
    outputDatasets ARRAY<STRUCT<dataSourceId: STRING, id: STRING>>
"""
EXECUTION = """
    dataflowId STRING, id BIGINT, state STRING, failed BOOLEAN, activationType STRING,
    beginTime BIGINT, endTime BIGINT, totalRowsRead BIGINT, totalBytesRead BIGINT,
    totalRowsWritten BIGINT, totalBytesWritten BIGINT, inputDataSources ARRAY<STRING>,
    outputDataSources ARRAY<STRING>,
    errors ARRAY<STRUCT<localizedMessage: STRING, message: STRING>>, dataFlowVersion BIGINT
"""
_RUN = """executionId: BIGINT, currentState: STRING, startedAt: BIGINT, endedAt: BIGINT,
    rowsInserted: BIGINT, bytesInserted: BIGINT, errors: ARRAY<STRING>"""
STREAM = f"""
    id BIGINT,
    dataSource STRUCT<id: STRING, name: STRING, dataProviderType: STRING, type: STRING,
        status: STRING, rowCount: BIGINT, columnCount: INT, owner: STRUCT<name: STRING>,
        tags: STRING, scheduleActive: BOOLEAN>,
    scheduleExpression STRING, scheduleState STRING, updateMethod STRING,
    lastExecution STRUCT<{_RUN}>, lastSuccessfulExecution STRUCT<{_RUN}>,
    currentExecution STRUCT<executionId: BIGINT>, currentExecutionState STRING
"""
_REFS = "ARRAY<STRUCT<formulaId: STRING, column: STRING>>"
CARD_DEFINITION = f"""
    urn STRING, formulas ARRAY<STRUCT<id: STRING, name: STRING, formula: STRING>>,
    subscriptions MAP<STRING, STRUCT<columns: {_REFS}, orderBy: {_REFS}, groupBy: {_REFS}>>
"""

DDL = {
    "formula_search": FORMULA_SEARCH,
    "formula_detail": FORMULA_DETAIL,
    "card_summary": CARD_SUMMARY,
    "card_info": CARD_INFO,
    "dataset_search": DATASET_SEARCH,
    "dataset_detail": DATASET_DETAIL,
    "dataflow_stub": DATAFLOW_STUB,
    "execution": EXECUTION,
    "stream": STREAM,
    "card_definition": CARD_DEFINITION,
}


def payload_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[name])
