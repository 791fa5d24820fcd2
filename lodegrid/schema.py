"""Column layouts of the stored tables (DDL strings, read with ``spark.read.schema``)."""

SCANS = ("id int, name string, status string, chain string, rpc_url_name string, scan_profile string, created_at timestamp, started_at timestamp, "
         "finished_at timestamp, toggles map<string,string>, total_targets int, completed_targets int, critical_count int, "
         "needs_investigation_count int, low_info_count int, false_positive_count int, error string")
TARGETS = ("id int, scan_id int, address string, chain string, label string, status string, source_verified boolean, is_proxy boolean, "
           "contract_name string, proxy_type string, implementation_address string, proxy_admin string, owner string, balance_eth double, "
           "workspace_path string, error string, created_at timestamp, updated_at timestamp")
TOOL_RUNS = ("id int, target_id int, tool_name string, status string, command string, stdout_path string, stderr_path string, "
             "json_output_path string, summary string, started_at timestamp, finished_at timestamp, exit_code int, timed_out boolean")
FINDINGS = ("id int, target_id int, detector string, title string, severity_candidate string, confidence_before_ai string, status string, "
            "classification string, description string, impact_score double, confidence_score double, evidence_json string, "
            "next_tests_json array<string>, ai_review_id int, created_at timestamp")
AI_REVIEWS = ("id int, finding_id int, model string, prompt_path string, classification string, rationale string, request_json string, "
              "response_json string, recommended_next_steps array<string>, created_at timestamp")
WATCH_TARGETS = ("id int, address string, chain string, label string, github_url string, scan_profile string, enabled boolean, "
                 "interval_seconds int, impl_address string, codehash string, admin string, owner string, last_checked_at timestamp, "
                 "last_change_at timestamp, created_at timestamp, last_scan_id int")
WATCH_EVENTS = ("id int, watch_target_id int, kind string, detail struct<old:string,new:string,error:string,deployer:string,block:bigint>, "
                "scan_id int, created_at timestamp")
DEPLOYER_WATCHES = ("id int, deployer_address string, chain string, label string, scan_profile string, enabled boolean, interval_seconds int, "
                    "last_block_checked bigint, deployed_count int, created_at timestamp, last_checked_at timestamp")
SUPPRESSIONS = "id int, fingerprint string, address string, detector string, title string, reason string, created_at timestamp"
