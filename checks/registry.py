"""All registered queries: name -> (Spark job, SQL twin or None)."""

from checks import event_checks, message_checks, ops_checks, page_checks, stream_checks, url_checks

CHECKS = {
    **url_checks.CHECKS, **message_checks.CHECKS, **page_checks.CHECKS, **ops_checks.CHECKS,
    **stream_checks.CHECKS, **event_checks.CHECKS,
}
