"""Decision policies as column expressions: probabilities in, (action, escalate, route, reason) out."""
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from colloquy import constants as K
from colloquy.functions.probs import argmax_first
from colloquy.operators.grids import route_with_oos


@dataclass(frozen=True)
class Policy:
    theta_interrupt: float = K.THETA_INTERRUPT
    theta_yield: float = K.THETA_YIELD
    theta_escalate: float = K.THETA_ESCALATE
    theta_oos: float = K.THETA_OOS
    vad_pause_ms: int = K.VAD_PAUSE_MS
    max_wait_ms: int = K.MAX_WAIT_MS


def checked(p: Column, name: str) -> Column:
    """The probability, or a failure when it is NULL, NaN or outside [0, 1]."""
    ok = p.isNotNull() & ~F.isnan(p) & (p >= 0.0) & (p <= 1.0)
    return F.when(ok, p).otherwise(F.raise_error(F.concat(
        F.lit(f"{name} must be a probability in [0, 1], got "), F.coalesce(
            p.cast("string"), F.lit("NULL")))).cast("double"))


def _checked_all(p: Column, name: str) -> Column:
    ok = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0.0) & (x <= 1.0))
    return F.when(ok, p).otherwise(F.raise_error(F.lit(
        f"{name} must hold probabilities in [0, 1]")).cast("array<double>"))


def _two(p: Column) -> Column:
    return F.format_string("%.2f", p)


def pause_policy(p_complete: Column, p_route: Column, p_escalate: Column, silence_ms: Column,
                 route_labels, cfg: Policy = Policy()) -> Column:
    """The action at a user pause. Routing and escalation act only when the agent responds."""
    pc, pe = checked(p_complete, "p(turn_complete)"), checked(p_escalate, "p(escalate)")
    names = F.array(*[F.lit(x) for x in route_labels])
    oos = list(route_labels).index(K.OUT_OF_SCOPE)
    routed = F.get(names, route_with_oos(_checked_all(p_route, "p(route)"), oos, cfg.theta_oos))
    action = (F.when(pc >= cfg.theta_yield, "respond")
              .when(silence_ms >= cfg.max_wait_ms, "respond_after_timeout")
              .otherwise("keep_listening"))
    responds = (pc >= cfg.theta_yield) | (silence_ms >= cfg.max_wait_ms)
    hand_off = responds & (pe >= cfg.theta_escalate)
    ms = F.format_string("%.0f", silence_ms.cast("double"))
    why = (F.when(pc >= cfg.theta_yield, F.concat(
        F.lit("turn_complete "), _two(pc), F.lit(f" >= {cfg.theta_yield}")))
        .when(silence_ms >= cfg.max_wait_ms, F.concat(
            F.lit("silence "), ms, F.lit(f" ms >= max_wait {cfg.max_wait_ms} ms")))
        .otherwise(F.concat(F.lit("turn_complete "), _two(pc), F.lit(
            f" < {cfg.theta_yield}, silence "), ms, F.lit(f" ms < {cfg.max_wait_ms} ms"))))
    tail = F.when(hand_off, F.concat(F.lit("; escalate "), _two(pe), F.lit(
        f" >= {cfg.theta_escalate}, passed on"))).otherwise("")
    return F.struct(action.alias("action"), hand_off.alias("escalate"),
                    F.when(responds, routed).alias("route"), F.concat(why, tail).alias("reason"))


def barge_policy(p_barge: Column, p_escalate: Column, cfg: Policy = Policy()) -> Column:
    """The action when the user speaks over the agent; p_barge in the order of the barge_in labels."""
    p, pe = _checked_all(p_barge, "p(barge_in)"), checked(p_escalate, "p(escalate)")
    labels = K.DECISION_LABELS["barge_in"]
    p_int = F.get(p, F.lit(labels.index("interruption")))
    top = F.get(F.array(*[F.lit(x) for x in labels]), argmax_first(p))
    esc, stop = pe >= cfg.theta_escalate, p_int >= cfg.theta_interrupt
    action = (F.when(esc | stop, "stop_and_listen")
              .when(top.isin("backchannel", "interruption"), "keep_talking").otherwise("ignore"))
    why = (F.when(esc, F.concat(F.lit("escalate "), _two(pe), F.lit(
        f" >= {cfg.theta_escalate}, stopped and passed on")))
        .when(stop, F.concat(F.lit("interruption "), _two(p_int), F.lit(
            f" >= {cfg.theta_interrupt}")))
        .when(top.isin("backchannel", "interruption"), F.concat(
            top, F.lit(" (p="), _two(F.array_max(p)), F.lit("), interruption "), _two(p_int),
            F.lit(f" < {cfg.theta_interrupt}")))
        .otherwise(F.concat(F.lit("noise (p="), _two(F.array_max(p)), F.lit(")"))))
    return F.struct(action.alias("action"), esc.alias("escalate"),
                    F.lit(None).cast("string").alias("route"), why.alias("reason"))
