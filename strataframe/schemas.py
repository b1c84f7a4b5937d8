"""Record shapes that the operators take and give, as Spark DDL.

Collections are ordered by an explicit ``ord`` column: iteration order is data, not an accident of storage.
"""

from __future__ import annotations

VECTOR = "ARRAY<DOUBLE>"

OBJECTS = (
    "ord BIGINT, name STRING, type STRING, location ARRAY<DOUBLE>, rotation ARRAY<DOUBLE>, scale ARRAY<DOUBLE>, "
    "visible BOOLEAN, parent STRING, materials ARRAY<STRING>, bound_box ARRAY<ARRAY<DOUBLE>>, "
    "matrix_world ARRAY<ARRAY<DOUBLE>>, mesh STRUCT<vertices:BIGINT,edges:BIGINT,polygons:BIGINT>"
)
ASSETS = "ord BIGINT, asset_id STRING, name STRING, type INT, categories ARRAY<STRING>, download_count BIGINT"
CATEGORIES = "ord BIGINT, category STRING, n BIGINT"
ASSET_FILES = "map_type STRING, resolution STRING, format STRING, url STRING, include MAP<STRING,STRUCT<url:STRING>>"
IMAGES = "ord BIGINT, name STRING"
NODES = "node STRING, type STRING, image STRING, colorspace STRING"
LINKS = "from_node STRING, from_socket STRING, to_node STRING, to_socket STRING"
MODEL_RESULTS = (
    "results ARRAY<STRUCT<name:STRING,uid:STRING,user:STRUCT<username:STRING>,license:STRUCT<label:STRING>,"
    "faceCount:BIGINT,isDownloadable:BOOLEAN>>"
)
THUMBNAILS = "uid STRING, images ARRAY<STRUCT<width:INT,height:INT,url:STRING>>"
JOBS = "job_id STRING, status_list ARRAY<STRING>"
EVENTS = (
    "customer_uuid STRING, session_id STRING, event_type STRING, tool_name STRING, prompt_text STRING, success BOOLEAN, "
    "duration_ms DOUBLE, error_message STRING, version STRING, platform STRING, app_version STRING, metadata STRING, "
    "event_timestamp BIGINT"
)
COMMAND = "type STRING, params STRING"
RESPONSE = "status STRING, result STRING, message STRING"

# Numeric settings with their bounds and defaults.
SETTINGS = {
    "port": (1024, 65535, 9876),
    "octree_resolution": (128, 512, 256),
    "num_inference_steps": (20, 50, 20),
    "guidance_scale": (1.0, 10.0, 5.5),
}
