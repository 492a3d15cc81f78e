from scrivenry.operators import evaluation, metrics

CONTEXTS = "qid long, ref long, doc_id long, pages array<long>"
ANSWERS = "name string, qid long, answer string, said string"


def test_answers_are_measured_by_what_they_cite(spark):
    contexts = spark.createDataFrame([(1, 1, 10, [4]), (1, 2, 11, [1]), (2, 1, 12, []), (3, 1, 13, [2])], CONTEXTS)
    relevant = spark.createDataFrame([(1, 10, [4, 5]), (1, 11, [7]), (2, 12, [3])], "qid long, doc_id long, pages array<long>")
    said = '{"supported": 1, "total": 2, "score": 5}'
    answers = spark.createDataFrame(
        [("p", 1, "One [1], again [1], two [2], and [9].", said), ("p", 2, "Yes [1]", said), ("p", 3, "Made up [1]", said), ("q", 1, " NOT_FOUND. ", said), ("q", 2, "No source at all", said), ("q", 3, None, None), ("q", 4, "Wrong number [3]", said)],
        ANSWERS,
    )
    cited = evaluation.cited_sources(answers, contexts)
    assert {(r.name, r.qid, r.ref, r.known) for r in cited.collect()} == {("p", 1, 1, True), ("p", 1, 2, True), ("p", 1, 9, False), ("p", 2, 1, True), ("p", 3, 1, True), ("q", 4, 3, False)}
    correct = {(r.qid, r.ref): r.correct for r in evaluation.correct_citations(cited, relevant).collect()}
    # The page differs for the second passage; the third has no pages, so that its document is enough.
    assert correct == {(1, 1): True, (1, 2): False, (2, 1): True, (3, 1): False}
    out = evaluation.answer_outcomes(answers, contexts, relevant)
    rows = {(r.name, r.qid): (r.answerable, r.refused, r.cited, r.correct) for r in out.collect()}
    assert rows == {
        ("p", 1): (True, False, 2, 1), ("p", 2): (True, False, 1, 1), ("p", 3): (False, False, 1, 0),
        ("q", 1): (True, True, 0, 0), ("q", 2): (True, True, 0, 0), ("q", 3): (False, True, 0, 0), ("q", 4): (False, True, 0, 0),
    }
    report = {r.name: r for r in metrics.answer_report(out, "name").collect()}
    assert (report["p"].faithfulness, report["p"].relevance, report["p"].citation_accuracy) == (0.5, 1.0, 0.6667)
    assert (report["p"].not_found_accuracy, report["p"].false_refusal) == (0.0, 0.0)
    # Nothing was answered, so there is nothing to measure of answers.
    assert (report["q"].faithfulness, report["q"].citation_accuracy, report["q"].not_found_accuracy, report["q"].false_refusal) == (None, None, 1.0, 1.0)


def test_no_answers_no_report(spark):
    none = evaluation.answer_outcomes(spark.createDataFrame([], ANSWERS), spark.createDataFrame([], CONTEXTS), spark.createDataFrame([], "qid long, doc_id long, pages array<long>"))
    assert none.count() == 0 and metrics.answer_report(none, "name").count() == 0
