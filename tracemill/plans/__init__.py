from tracemill.plans import catalog, machines, placement, report, tasks, usage

__all__ = ["catalog", "machines", "placement", "report", "tasks", "usage"]
