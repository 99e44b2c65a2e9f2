"""Phrase lists and patterns, as data. Each list is sorted by its phrases' last characters; order never matters."""

from __future__ import annotations


def _of(text: str) -> tuple[str, ...]:
    return tuple(text.replace("\n", "").split("|"))


#: Wording that narrows to a conclusion.
CONCLUSIONS = _of("""
yeah,|yup,|all things considered|with this in mind|clicks into place|hence|i'd conclude|
i would conclude|we conclude|it looks like|it seems like|the bottom line|therefore|
i think that makes sense|makes sense because|i believe|to summarize|considering all|all in all|
so overall|fits the bill|makes sense given|we obtain|in conclusion|this points to|
putting it all together|i think the answer|so the answer|final answer|this indicates|which gives|
the solution is|the answer is|the diagnosis is|the result is|given all this|it sure seems|
this confirms|everything fits|this suggests|this gives us|this tells us|thus|we find that|
this means that|i'd bet|we get|in short|the key takeaway|so the key|most likely|fits perfectly|
in summary|最終的な答え|結論として|したがって|よって|まとめると|答えは|以上から|所以|可以得出|由此得出|我们得到|由此可得|答案是|最终答案|因此|总结来说|综上所述|
최종 답|결론적으로|종합하면|따라서|정답은""")

#: Marks in front of a formatted answer.
DELIMITERS = _of("""
solution:|answer:|result:|output:|答え:|答案:|结论:|정답:|answer =|```|\\boxed{|答え：|答案：|结论：|정답：""")

#: Wording of someone who is not done.
UNCERTAIN = _of("""
i'm confused|wait, maybe|back to square one|i'm not sure|i am not sure|i need to rethink|
let me reconsider|let me try another|let me start over|that can't be right|
this doesn't seem right|hmm, actually|ちょっと分からない|不确定|让我重新考虑|잘 모르겠""")

#: Step markers, worth three.
STRONG = _of("""
1) |2) |3) |4) |1. |2. |3. |4. |5. |second,|third,|first,|finally,|step 1|step 2|step 3|step 4|
step 5""")

#: Logical connectors, worth two.
MEDIUM = _of("""
since|therefore|because|building on|which implies|from this|this means|thus|it follows|
given that|we know that|as a result|consequently""")

#: Transitions, worth one.
WEAK = _of("""
oh,|hmm,|so,|also,|however,|wait,|now,|okay,|alternatively,|actually,|on the other hand|
let me think|then|moving on|okay so|let me consider|oh right|but wait|next|so now|finally""")

#: A check that is announced.
EXPLICIT = _of("""
checking:|let me validate|cross-checking|substituting back|i should check|let me check|
we can check|let's check|sanity check|let me double-check|let me confirm|plugging back in|
to confirm this|i should verify|let me verify|we can verify|to verify|let's verify|
does this satisfy|確認すると|代入して確かめる|检查一下|验证一下|代回去|重新检查|検算|확인해보면|대입해보면|검산""")

#: Wording that finds things consistent.
IMPLICIT = _of("""
indeed|returns the expected|as we expected|as expected|the clinical picture|which makes sense|
this makes sense|this agrees with|this aligns with|consistent with|fits together|this matches|
output matches|test passes|running this gives|the data confirms|which confirms|this confirms|
which explains|this explains|everything fits|this supports|the evidence suggests|
gives the correct|produces the right|the symptoms are consistent|the presentation is consistent|
this is consistent|the findings support|that checks out|this is supported by|確かめると|確かに|やはり|满足条件|
正好|确实|果然|的确|맞다|역시|조건을 만족""")


#: Patterns of starting over; each is counted by itself, whatever the case. ``{s}`` is a run of white space, ``{b}`` a word
#: boundary. Before each stands what every match holds, in lower case.
RESTARTS = (
    ("actually i was wrong", "{b}actually i was wrong"),
    ("i need to restart", "{b}i need to restart"),
    ("let me recalculate", "{b}let me recalculate"),
    ("no wait,", "{b}no wait,"),
    ("on second thought", "{b}on second thought"),
    ("let me approach this", "{b}let me approach this differently"),
    (" an error", "{b}i (?:see|made) an error"),
    ("let me", "{b}(?:ugh|hmm+),?{s}let me"),
    ("wait", "{b}wait,?{s}(?:actually|let me|i need to)"),
    ("actually", "{b}actually,?{s}(?:that's wrong|let me|wait|no)"),
    ("let me re", "{b}let me (?:rethink|redo|restart|reconsider)"),
    ("let me ", "{b}let me (?:try again|start over)"),
    ("that", "{b}that(?: is|'s) (?:not right|incorrect|wrong),?{s}(?:i|let)"),
)


#: Marks of mathematics and of code in a problem.
MATH_SIGNS = "≠≥≤∞√∏∑∫"
MATH_WORDS = _of("_{|^{|\\binom|\\sqrt|\\lim|\\sum|\\int|\\frac")
CODE_WORDS = _of("void |#include|fn |import |class |function |def ")
