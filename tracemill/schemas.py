"""Spark schemas of the entities, as DDL."""

CONFIG_STEP = "STRUCT<type: STRING, parameters: STRUCT<command: STRING, files: ARRAY<STRUCT<url: STRING, path: STRING>>, path: STRING, seconds: BIGINT, shell: BOOLEAN, window_name: STRING>>"
ENV_CONFIG = f"id STRING, snapshot STRING, trajectory STRING, possibility_of_env_change STRING, proxy BOOLEAN, fixed_ip BOOLEAN, related_apps ARRAY<STRING>, provide_info ARRAY<STRING>, evaluator STRUCT<func: STRING>, config ARRAY<{CONFIG_STEP}>"
TASK_CONFIG = f"{ENV_CONFIG}, config_id STRING, instruction STRING, agentnet_id STRING, provide_contents BOOLEAN"
TRAJECTORY_LINE = "step_num BIGINT, response STRING, action STRING, screenshot_file STRING"
ATTEMPT = "STRUCT<attempt: INT, agent_pass: BOOLEAN, result: STRING>"
VERIFY_RESULT = f"task_id STRING, instruction STRING, instruction_config_path STRING, agent_steps INT, agent_steps_raw INT, traj_path STRING, max_attempts INT, num_attempts_run INT, agent_pass BOOLEAN, result STRING, attempt_results ARRAY<{ATTEMPT}>, error STRING"
MESSAGE = "STRUCT<role: STRING, content: STRING>"
PREFERENCE_SAMPLE = f"conversations ARRAY<{MESSAGE}>, chosen {MESSAGE}, rejected {MESSAGE}, learn_type STRING, images ARRAY<STRING>"
STEP_PAIR = "step_num BIGINT, input_screenshot STRING, teacher_cot STRUCT<response: STRING, action: STRING>, student_cot STRUCT<response: STRING, action: STRING>"
MODEL_RESPONSE = "stage STRING, prompt_sha STRING, attempt INT, output_text STRING, error STRING"
