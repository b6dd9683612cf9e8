"""All query suites."""

from orepulse.plans import suite_jobs, suite_kpi, suite_reshape, suite_service, suite_stats, suite_text

SUITES = [suite_kpi.suite, suite_stats.suite, suite_reshape.suite, suite_text.suite, suite_service.suite, suite_jobs.suite]
