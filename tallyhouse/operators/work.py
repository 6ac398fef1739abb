"""Work: the prioritised queue and the progress of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions import ranking

TERMINAL_TASKS = ("completed", "cancelled")


def queue(works: DataFrame, assignments: DataFrame) -> DataFrame:
    """Released work without an active assignment, ranked in its tenant and warehouse."""
    waiting = works.where("state = 'released'").join(assignments.where("state = 'active'").select("work_id").distinct(), "work_id", "left_anti")
    order = [F.desc("priority"), F.asc_nulls_last("due_at"), F.col("created_at"), F.col("work_id")]
    return ranking.numbered(waiting, ("tenant_id", "warehouse_id"), order, "queue_rank")


def next_task(tasks: DataFrame) -> DataFrame:
    """Of each work: its first task, and the task with the least sequence that isn't ended (ties: the least id)."""
    place = F.struct("sequence", "task_id")
    open_place = F.when(~F.col("state").isin(*TERMINAL_TASKS), place)
    found = tasks.groupBy("work_id").agg(F.min(place).alias("first"), F.min(open_place).alias("next"), F.count("*").alias("tasks"), F.count_if(F.col("state") == "completed").alias("completed"))
    return found.select("work_id", F.col("first.task_id").alias("first_task"), F.col("next.task_id").alias("next_task"), F.col("next.sequence").alias("next_sequence"), "tasks", "completed")


def doubly_assigned(assignments: DataFrame) -> DataFrame:
    """Work with more than one active assignment."""
    return assignments.where("state = 'active'").groupBy("work_id").agg(F.count("*").alias("active")).where("active > 1")


#: Commands on work, and the states from which they may go on; fixed values.
COMMANDS = ("release", "claim", "start", "confirm", "raise", "resume", "cancel")
#: Those of them that look at their task.
TASK_COMMANDS = ("start", "confirm", "raise", "resume")
EXECUTABLE, CANCELLABLE = ("assigned", "in_progress"), ("planned", "released", "assigned")
STARTED_TASKS = ("in_progress", "exception", "completed")


def judge_commands(commands: DataFrame, works: DataFrame, tasks: DataFrame, assignments: DataFrame, executions: DataFrame) -> DataFrame:
    """command_id, reason (null: accepted), and what an accepted command makes of work and task, and of the task that is next.

    ``commands``: command_id, command, work_id, task_id, resource_id, domain_ref; ``works``: work_id, state; ``tasks``: work_id, task_id,
    sequence, state, needs_ref; ``assignments``: work_id, resource_id, state; ``executions``: task_id, resource_id, state.
    Each command is judged against the tables as they are.
    """
    c = F.col
    place = F.struct("sequence", "task_id")
    open_ = ~c("state").isin(*TERMINAL_TASKS)
    whole = tasks.groupBy("work_id").agg(
        F.bool_and(c("state") == "pending").alias("all_pending"), F.bool_or(c("state").isin(*STARTED_TASKS)).alias("any_started"), F.min(place).alias("first"), F.min(F.when(open_, c("sequence"))).alias("first_open"),
    ).select("work_id", "all_pending", "any_started", c("first.task_id").alias("first_task"), "first_open")
    later = Window.partitionBy("work_id").orderBy(F.desc("sequence")).rangeBetween(Window.unboundedPreceding, -1)
    after = F.min(F.when(open_, F.struct("sequence", "task_id", "state"))).over(later)
    one = tasks.withColumn("after", after).select("task_id", "sequence", c("state").alias("task_state"), "needs_ref", c("after.task_id").alias("next_task"), c("after.state").alias("next_state"))
    own = assignments.where("state = 'active'").groupBy("work_id").agg(F.min("resource_id").alias("assigned_to"))
    live = executions.where("state in ('in_progress', 'blocked')").groupBy("task_id").agg(F.min(F.struct("state", "resource_id")).alias("run"))
    run = live.select("task_id", c("run.state").alias("run_state"), c("run.resource_id").alias("run_by"))
    of_work = commands.join(works.select("work_id", c("state").alias("work_state")), "work_id", "left").join(whole, "work_id", "left").join(own, "work_id", "left")
    on_tasks = F.coalesce(c("command").isin(*TASK_COMMANDS), F.lit(False))
    of_task = of_work.where(on_tasks).drop("all_pending", "any_started", "first_task").join(one, "task_id", "left").join(run, "task_id", "left")
    found = of_task.unionByName(of_work.where(~on_tasks), allowMissingColumns=True)
    mine = (c("run_state") == "in_progress") & (c("run_by") == c("resource_id")) & (c("assigned_to") == c("resource_id"))
    on_task = c("task_state").isNull()
    reasons = {
        "release": [(c("work_state") != "planned", "not_planned"), (~F.coalesce("all_pending", F.lit(True)), "tasks_not_pending"), (c("first_task").isNull(), "no_task")],
        "claim": [(c("work_state") != "released", "not_released")],
        "start": [
            (on_task, "unknown_task"), (~c("work_state").isin(*EXECUTABLE), "not_executable"), (c("task_state") != "ready", "task_not_ready"), (c("first_open") < c("sequence"), "sequence_skipped"),
            (c("assigned_to").isNull(), "no_assignment"), (c("assigned_to") != c("resource_id"), "not_the_assigned_resource"),
        ],
        "confirm": [
            (on_task, "unknown_task"), (c("task_state") != "in_progress", "task_not_in_progress"), (c("needs_ref") & (F.trim(F.coalesce("domain_ref", F.lit(""))) == ""), "domain_reference_required"),
            (~F.coalesce(mine, F.lit(False)), "no_live_execution"), (c("next_state") != "pending", "next_task_not_pending"),
        ],
        "raise": [(on_task, "unknown_task"), (c("task_state") != "in_progress", "task_not_in_progress"), (~F.coalesce(mine, F.lit(False)), "no_live_execution")],
        "resume": [(on_task, "unknown_task"), (c("task_state") != "exception", "no_open_exception"), (~F.coalesce(c("run_state") == "blocked", F.lit(False)), "no_blocked_execution"), (c("assigned_to").isNull(), "no_assignment")],
        "cancel": [(~c("work_state").isin(*CANCELLABLE), "execution_began"), (F.coalesce("any_started", F.lit(False)), "execution_began")],
    }
    reason = F.when(c("work_state").isNull(), "unknown_work")
    for command, checks in reasons.items():
        reason = F.coalesce(reason, *[F.when((c("command") == command) & broken, name) for broken, name in checks])
    reason = F.coalesce(reason, F.when(~c("command").isin(*COMMANDS), "unknown_command"))
    last = c("next_task").isNull()
    to_work = {"release": "released", "claim": "assigned", "start": "in_progress", "raise": "exception", "resume": "assigned", "cancel": "cancelled"}
    to_task = {"start": "in_progress", "confirm": "completed", "raise": "exception", "resume": "ready"}

    def becomes(table: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c("command"))

    work_state = F.when((c("command") == "confirm") & last, "completed").otherwise(F.coalesce(becomes(to_work), c("work_state")))
    ready = F.when(c("command") == "release", c("first_task")).when(c("command") == "confirm", c("next_task"))
    fine = c("reason").isNull()
    judged = found.withColumn("reason", reason)
    return judged.select("command_id", "reason", F.when(fine, work_state).alias("work_state"), F.when(fine, becomes(to_task)).alias("task_state"), F.when(fine, ready).alias("ready_task"))


def judge_confirmations(confirmations: DataFrame, domain: DataFrame) -> DataFrame:
    """command_id and reason of confirmations that stand or fall with a change of stock (``confirmations`` and ``domain``: command_id, reason):
    neither goes without the other."""
    found = confirmations.select("command_id", F.col("reason").alias("w")).join(domain.select("command_id", F.col("reason").alias("d"), F.lit(True).alias("there")), "command_id", "left")
    return found.select("command_id", F.coalesce("w", F.when(F.col("there").isNull(), "domain_result_missing"), "d").alias("reason"))
