"""Distinct words of whole licence texts, the templates that licence files are compared to."""

TEXTS = [
    ("agpl-3.0",
     "0 1 10 11 12 13 14 15 16 17 1996 2 20 2007 28 29 3 30 4 5 6 60 6b 6d 7 8 9 a ability about above absence "
     "absolute absolutely abuse accept acceptance access accessible accompanied accompanies accord according "
     "achieve acknowledges acquired across actions activities activity actual actually adapt add added "
     "additional address addressed adopted adversely advised affects affero affirmed affirms after against "
     "aggregate agree agreed agreement aim all alleging allow allowed along already also alternative although "
     "among an ancillary and anti any anyone anything applicable applications applied applies apply "
     "appropriate appropriately approximates are area arise arising arrange arrangement article as asking "
     "assert assets associated assume assumption assumptions assures at attach attempt attributed attributions "
     "author authorization authorized authorizes authorizing authors automatic automatically available avoid "
     "away b based basic be because been behalf being believe below benefit best between beyond body both box "
     "brief business but by c called can cannot carry case cases cause cease certain cessation change changed "
     "changing characterized charge choose choosing circumstances circumvention civil claim claims class clear "
     "clearly closely code collect combination combine combined comes commands commercial commitment common "
     "communication community compilation compilations compiler compliance comply component computer computers "
     "concerning concerns conditioned conditions connection consequence consequential consider considered "
     "consistent conspicuously constantly constitutes construed consumer contact contain containing contains "
     "content contents context continue continued contractual contradict contrast contributor control "
     "controlled convenient convey conveyance conveyed conveying conveys copies copy copying copyleft "
     "copyright copyrightable copyrighted correction corresponding cost could counterclaim countries country "
     "course court courts covenant coverage covered criterion cross cure customarily customary customer d "
     "damages danger data date days december decide declining deemed defective defenses defined definition "
     "definitions denied denominated deny denying deprive designated designed detail details determining "
     "develop developers development devices differ different differently direction directions directly "
     "disclaim disclaimer disclaiming discriminatory display displayed displays distinguishing distribute "
     "distributed distributing distribution do document documented does domains doubtful downstream durable "
     "dwelling dynamically e each earlier effect effected effective effectively efforts either electronic "
     "embodied employer enable enables end enforce enforcing ensure entered entire entirely entity equivalent "
     "erroneously essential even event ever every everyone exact example except exceptions excluded excluding "
     "exclusion exclusive exclusively excuse executable execute executing exercise exercising expected expects "
     "explains explicitly express expressed expressly extend extended extensions extent f facilitating "
     "facilities fails failure fair family fashion favor feature fee file files finally find first fitness "
     "fixed flow follow following for forbid force form format forms found foundation free freedom freedoms "
     "from fsf fulfilling full functioning fundamentally further future general generally generate get give "
     "given gives giving gnu governed gpl grant granted grants gratis greatest guarantee gui had has have "
     "having hereafter holder holders hope hosts household how however html https hypothetical idea "
     "identifiable if implement implementation implied import importing impose imposed in inability inaccurate "
     "inc incidental include included includes including inclusion incompatible incorporating incorporation "
     "indemnification independent indicate indicating individual individuals industrial inform information "
     "infringe infringed infringement initiate inside install installation installed instead intact intended "
     "intention interacting interaction interactive interchange interest interface interfaces interfered "
     "interpretation interpreter intimate into invalidate irrevocable is it item its itself june keep kernel "
     "key keys kind kinds know knowingly knowledge language larger later law laws lawsuit least legal lesser "
     "lgpl liability liable libraries library license licensed licensee licensees licenses licensing licensors "
     "like likewise limit limitation limited limiting line link linked linking list litigation local long loss "
     "losses machine made mail maintain major make makes making manner manufacturer march marked marks masks "
     "material materially may meaning means measure measures medium meet meets menu merchantability mere "
     "merging met methods might misrepresentation mode model modification modifications modified modifies "
     "modify modifying more moreover most must name names nature necessary need needed neither network new "
     "next no non noncommercially nor normal normally not nothing notice notices notifies notify "
     "notwithstanding number numbered object obligate obligated obligations occasionally occurring occurs of "
     "offer offered offering official on one only operate operated operating operation opportunity option "
     "options or order org organization organizations origin original other others otherwise our out output "
     "outside own owned packaged packaging paper paragraph paragraphs part particular parties parts party pass "
     "password patent patents pattern payment peer peers performance performing permanently permission "
     "permissions permissive permit permits permitted perpetuity personal pertinent physical physically pieces "
     "place please plus pointer portion possesses possession possibility possible power practical practice "
     "preamble precise precisely predecessor preferred present presents preservation prevent prevented "
     "previous price primarily prior private problems procedures procuring produce product products program "
     "programmer programming programs prohibit prohibiting prohibits prominent prominently propagate "
     "propagating propagation property proprietary protect protecting protection protocols prove provide "
     "provided provision provisionally proxy public publicity publicly publish published purpose purposes "
     "pursuant qualify quality read readable readily reading ready reason reasonable receipt receive received "
     "receives receiving recipient recipients recognized redistribute referring refers refrain regard "
     "regardless regenerate reinstated relationship released relevant relicensing relying remain remains "
     "remote remotely removal remove render rendered repair represent require required requirement "
     "requirements requires requiring resolved respect responsibilities responsible restrict restricting "
     "restriction restrictions result resulting results retains return reviewing revised right rights risk rom "
     "royalty rules run running runs s safest sake sale same satisfy saying school scope scripts secondarily "
     "section sections see sell selling semiconductor separable separate separately server serves service "
     "servicing shall share shared short should show sign significant similar simultaneously single so "
     "software sold sole solely some source spare speak special specific specifically specified specifies "
     "specify spirit stand standard standards start starts state stated statement states stating status steps "
     "storage subdividing subject sublicenses sublicensing subprograms subroutine subsection substantial "
     "substantially such sue suffice supplement support supports sure surrender survive sustained system "
     "systematic take tangible technological tells term terminal terminate terminated terminates termination "
     "terms than that the their them then there therefore these they things third this those though threatened "
     "three through thus time to too tools trade trademark trademarks transaction transfer transferred "
     "transferring transmission treated treaty two type typical unacceptable under unless unlimited unmodified "
     "unnecessary unpacking until updates use used useful user users uses using valid verbatim version "
     "versions view violates violation visible void volume w waive waiver want warranties warranty was way "
     "ways we welcome well were what whatever when where whether which who whole whom whose why widely will "
     "window wipo wish with within without work working works worldwide would writing written www year years "
     "you your yourself"),
    ("apache-2.0",
     "1 2 2.0 2004 3 4 5 50 6 7 8 9 a above acceptance accepting act acting acts add addendum additional "
     "additions advised against agree agreed agreement all alleging alone along alongside also an and "
     "annotations any apache appear appendix applicable applies apply appropriate appropriateness archives are "
     "arising as asserted associated assume at attach attached attribution authorized authorship available b "
     "based basis be been behalf below beneficial bind boilerplate brackets but by c cannot carry cause "
     "changed character charge choose claim claims class code combination comment commercial common "
     "communication compiled compliance complies computer conditions configuration consequential consistent "
     "conspicuously constitutes construed contained content contents contract contribution contributions "
     "contributor contributory control controlled conversions copies copy copyright counterclaim cross "
     "customary d damages date defend defined definition definitions deliberate derivative derived describing "
     "description designated determining different direct direction disclaimer discussing display distribute "
     "distributed distribution do document documentation does don each easier editorial either elaborations "
     "electronic enclosed end entities entity even event example except excluding exclusive executed exercise "
     "exercising explicitly express failure fee fields fifty file filed files fitness following for form "
     "format free from generated give goodwill governing grant granted granting grants grossly harmless has "
     "have hereby herein hold how however http i identification identifying if ii iii implied import improving "
     "in inability incidental include included includes including inclusion incorporated incurred indemnify "
     "indemnity indicated indirect individual information informational infringed infringement institute "
     "intentionally interfaces irrevocable is issue its january kind language law lawsuit least legal "
     "liability liable licensable license licensed licenses licensor limitation limitations limited link lists "
     "litigation loss losses made mailing make making malfunction managed management marked marks may mean "
     "means mechanical media medium meet merchantability merely modifications modified modify modifying more "
     "must name names necessarily negligence negligent no non normally not nothing notice notices "
     "notwithstanding object obligations obtain of offer on one only or org origin original other otherwise "
     "out outstanding own owner ownership page part particular party patent percent perform permission "
     "permissions perpetual pertain places possibility power preferred prepare printed product prominent "
     "provide provided provides publicly purpose purposes readable reason reasonable received recipients "
     "recommend redistributing redistribution regarding remain replaced represent representatives reproduce "
     "reproducing reproduction required responsibility responsible result resulting retain revisions rights "
     "risks royalty s same section sections see sell sent separable separate service shall shares should "
     "software sole solely source special specific state stated statement stating stoppage subject sublicense "
     "submission submit submitted subsequently such supersede support syntax systems t terminate terms text "
     "that the their then theory thereof third this those through title to tort tracking trade trademark "
     "trademarks transfer transformation translation types under union unless use using verbal version "
     "warranties warranty was we where wherever whether which while whole whom with within without work works "
     "worldwide writing written www you your yyyy"),
    ("artistic-1.0",
     "1 10 2 3 4 5 6 7 8 9 a about accompany accordance advertise aggregate aggregated aggregation all "
     "allowing also always an and any apply archive are arrangements artistic as associated at attempt "
     "automatically available away b basis be bear been belong below binary bug but by c called can cause "
     "change changed charge charged charges choose clearly code collection commercial commercially community "
     "comparably compiled complete computing conditions conflict considered construed control copied copies "
     "copy copying copyright copyrights corporation cost created customary d defined definitions derivatives "
     "derived development differences differs disclaimers distribute distributed distributing distribution do "
     "document documents domain duplicate duplication each embed embedded emulate end endorse equivalent "
     "executable executables express fail fall fashion fee fees file files fitness fixes following for form "
     "freely from generated get give giving handling has holder how however if image implied in include "
     "including input insert instructions intent interfaces interpreter into involved is it item itself "
     "justify language languages large larger least less library license limitation linked linking machine "
     "made maintains major make manual market may means media medium merchantibility mere methods modification "
     "modifications modified modify more must name named names neither net no non nor not notice notices "
     "object of on one only or order organization original other otherwise output over overt own package page "
     "pages paragraph paragraphs part particular people permission permitted place placing plus portability "
     "possibly posting preamble prior produced producing product products programs prominent promote provide "
     "provided public purpose re readable reasonable received recipients redistribute refers regression rename "
     "represent required restriction restrictions right s said same scripts semblance separate shall site so "
     "software sold some source specific specified standard state stating still subroutines such supplied "
     "support tests textual that the them then there these they thinking this though through time to together "
     "under undump unexec use used usenet user users uu uunet variables verbatim version via visible "
     "warranties way whatever when where which while whoever will wishes with within without would written you "
     "your yours"),
    ("bsd-2-clause",
     "1 2 a above advised all and any are arising as be binary business but by c caused code conditions "
     "consequential contract contributors copyright damage damages data direct disclaimed disclaimer "
     "distribution documentation even event exemplary express fitness following for form forms goods holders "
     "however if implied in incidental including indirect interruption is liability liable limited list loss "
     "materials merchantability met modification must negligence no not notice of on or other otherwise out "
     "particular permitted possibility procurement profits provided purpose redistribution redistributions "
     "reproduce reserved retain rights services shall software source special strict substitute such that the "
     "theory this to tort use warranties way whether with without"),
    ("bsd-3-clause",
     "1 2 3 a above advised all and any are arising as be binary business but by c caused code conditions "
     "consequential contract contributors copyright damage damages data derived direct disclaimed disclaimer "
     "distribution documentation endorse even event exemplary express fitness following for form forms from "
     "goods holder holders however if implied in incidental including indirect interruption is its liability "
     "liable limited list loss materials may merchantability met modification must name names negligence "
     "neither no nor not notice of on or other otherwise out particular permission permitted possibility prior "
     "procurement products profits promote provided purpose redistribution redistributions reproduce reserved "
     "retain rights services shall software source special specific strict substitute such that the theory "
     "this to tort use used warranties way whether with without written"),
    ("cc0-1.0",
     "1 1.0 11 1996 2 3 4 9 96 a abandoned abandons absence account accuracy acknowledges action adapt "
     "addition additional advertising affected affirmer affirms against all amended an and any applicable "
     "applied apply are arising as assert associated associating at attorney author authorship automatically "
     "available b based basis be below benefit build but by c can cancellation case causes cc0 certain claims "
     "clearing client code commercial commons communicate compensation competition concerning confer consents "
     "consideration contemplated contrary contravention contribute contributing copies copyright corporation "
     "corresponding council create creative creator cultural culture current d damages data database databases "
     "date deemed defects defined depicted detriment directive disclaimers disclaims discoverable display "
     "disrupt dissemination distribute distribution document does duration duty each ec effect effective "
     "efforts either elects enjoyment equitable equivalent errors european exclusive exercise existing "
     "expectation express extensions extent extraction fallback fear firm fitness following for form free "
     "freely from fully further future gain grants greater greatest has he heirs held her hereby hereunder his "
     "i ideal ii iii image implementation implementations implied in include including incorporate ineffective "
     "ineffectiveness information infringement intended intending into invalid invalidate invalidity "
     "irrevocable irrevocably is its iv judged jurisdictions kind knowledge known large latent later law laws "
     "legal legally liability license licensed likeness limitation limitations limited made makes march "
     "maximum may meaning medium member merchantability modify moral most motivations national necessary "
     "neighboring no non not now number obligation obtaining of offers on or original other others otherwise "
     "overtly owner owners paragraph parliament part partial particular party patent perform performer "
     "permanently permissible permissions permitted person persons pertaining possible present preserved "
     "privacy production promote promotional protected protecting protection provide provided provides public "
     "publicity publicly purpose purposes quiet reason redistribute regarding regards related relationship "
     "reliably relinquish remainder remaining representations reproduce reputation required rescission respect "
     "responsibility resulting retained reuse revocation right rights royalty s scientific services shall she "
     "should similar so statement statutory subject sublicensable subsequent successor successors such "
     "surrendered surrenders taking termination terms territories that the their then thereof these this those "
     "through throughout time title to trademark transferable translate treaty unconditional unconditionally "
     "under understands unfair universal unknown upon use v version vi vii voluntarily waived waiver waives "
     "warranties was well whatsoever whether will wish with without work works world worldwide"),
    ("gfdl-1.2",
     "0 02110 1 1.2 10 100 1301 2 2000 2001 2002 25 3 4 5 51 6 7 8 9 a above absence accept access accessible "
     "according acknowledgements acting actual add added addendum adding addition address addressed adjacent "
     "adjustment after agents aggregate aggregation all allowed along already also alternatives amount an and "
     "another any appear appearance appendices appendix applicability applicable applies apply appropriate "
     "approved are arranged arrangement arrangements as ascii assert assure at attempt author authoritative "
     "authors authorship automatic automatically available b back based be because been before begin beginning "
     "behalf being below between beyond body book boston both bracket but by c called can carry case certain "
     "chance changes changing choice choose clearly code collection collections combination combine combined "
     "combining come commercial commercially commonly compensation compilation complements complete compliance "
     "composed computer concerns conditions conflict conforming connection considered consisting contact "
     "contain containing contains contents continue contributor control copied copies copy copying copyleft "
     "copyright could cover covers create credit d deals dedications defined definition definitions delete "
     "derivative derivatives describing designate designated designed detail differ different directly "
     "disagreement disclaimer disclaimers disclaiming discourage display distinct distinguishing distribute "
     "distributed distribution do document documentation documents does download draft drawing drawings dtd "
     "duration e each edited edition editor editors effect effective either electronic else enclose end "
     "endorsement endorsements english enough ensure entire entities entitled entity equally equivalent "
     "ethical ever everyone example examples except exchange exclusively existing explain explicit expressly "
     "extract extracted f fall fewer fifth file filling first fit five floor follow following for form format "
     "formats formatters forming foundation four franklin free freedom freedoms from front full functional "
     "further future g general generally generated generic get give given gives giving gnu granted grants h "
     "half has have here herein historical history hold holder holders how however html https human i "
     "identical identify if image images immediately implication imply in inc include included includes "
     "independent individual individually input insert instruction into invariant is it item its itself j jpg "
     "just k kind known l language large last later latex latter law least legal legibly lend less license "
     "licensee licenses licensing likewise limit limited line list listed lists location locations long m ma "
     "machine made make manual manuals many markup material mathematics matter matters may meaning means "
     "measures media medium member mentioned merge modification modifications modified modify modifying more "
     "most multiple must n name named names near need needed needs network new next no noncommercially none "
     "nontrivial not nothing notice notices november number numbered numbering numbers o obstruct of old omit "
     "on one ones only onto opaque option or order org organization original other others otherwise output "
     "overall page pages paint parallel parentheses part particular parties passage passages pdf peer "
     "permission permit permitted persons philosophical pixels placed plain plus png political portion "
     "position possesses postscript preamble preceding precisely present preserve preserves prevail previous "
     "previously principal principally printed problems processing processors produced program programs "
     "prominent proprietary protocols provide provided providing prudent public publicity publicly publish "
     "published publisher publishers purpose purposes put qualify quantity read readable readers reading "
     "reasonably received recommend redistribute redistributing reference refers regarding regardless regards "
     "related relationship release released releasing remain remains replace replaced replacing represented "
     "reproduced requested require required requirement requires requiring respects responsible rest resulting "
     "retailers retitle review revised revising revisions rights role royalty rules s same satisfy saying says "
     "secondarily secondary section sections see sense sentence separate sgml short should shown similar "
     "simple single situation so software some special specific specification specified specifies specify "
     "spirit st standard stands state stated statements states stating steps storage straightforwardly subject "
     "sublicense subsequent substance substantial subunit such suit suitable take technical terminate "
     "terminated termination terms texinfo text textbook texts textual than that the their them themselves "
     "then there therein these they things this those three through thus thwart time title titles to together "
     "tone too tools translated translates translation translations transparent treated two typically "
     "unaltered under unique unless unlimited unmodified until up updated usa use used useful users using "
     "variety various verbatim version versions visible void volume voluminous warranties warranty was way we "
     "well were what whatsoever when whether which while who whoever whole whose wide widely will with within "
     "without word words work works world written www xcf xml xyz year years you your zero"),
    ("gfdl-1.3",
     "0 1 1.3 10 100 11 2 2000 2001 2002 2007 2008 2009 25 3 3.0 30 4 5 6 60 7 8 9 a above absence accept "
     "acceptance access accessible according acknowledgements acting actual add added addendum adding addition "
     "address addressed adjacent adjustment after agents aggregate aggregation alike all allowed along already "
     "also alternatives amount an and another any anybody appear appearance appendices appendix applicability "
     "applicable applies apply appropriate approved are arranged arrangement arrangements as ascii assert "
     "assure at attempt attribution august author authoritative authorizes authors authorship automatic "
     "automatically available b back based be because been before begin beginning behalf being below between "
     "beyond body book both bracket business but by c california called can carry case cc cease certain "
     "cessation chance changes changing choice choose clearly code collaboration collection collections "
     "combination combine combined combining come commercial commercially commonly commons compensation "
     "compilation complements complete composed computer concerns conditions conflict conforming connection "
     "considered consisting contact contain contained containing contains contents continue contributor "
     "control copied copies copy copying copyleft copyright copyrightable corporation could cover covers "
     "create creative credit cure d days deals decide dedications defined definition definitions delete "
     "derivative derivatives describing designate designated designed detail differ different directly "
     "disagreement disclaimer disclaimers disclaiming discourage display distinct distinguishing distribute "
     "distributed distributes distribution do document documentation documents does download draft drawing "
     "drawings dtd duration e each edit edited edition editor editors effect effective either electronic "
     "eligible else enclose end endorsement endorsements english enough ensure entire entities entitled entity "
     "equally equivalent ethical ever everyone example examples except exchange exclusively existing explain "
     "explicit explicitly expressly extract extracted f facilities fails fall fewer file filling finally first "
     "fit five follow following for form format formats formatters forming foundation four francisco free "
     "freedom freedoms from front fsf full functional further future g general generally generated generic get "
     "give given gives giving gnu granted grants h had half has have here herein historical history hold "
     "holder holders how however html https human i identical identify if image images immediately implication "
     "imply in inc include included includes incorporate incorporated independent individual individually "
     "input insert instruction into invariant is it item its itself j jpg just k kind known l language large "
     "last later latex latter law least legal legibly lend less license licensed licensee licenses licensing "
     "likewise limit limited line list listed lists location locations long m machine made make manual manuals "
     "many markup massive material mathematics matter matters may meaning means measures media medium member "
     "mentioned merge mmc modification modifications modified modify modifying more moreover most multiauthor "
     "multiple must n name named names near need needed needs network new next no noncommercially none "
     "nontrivial not nothing notice notices notifies notify november number numbered numbering numbers o "
     "obstruct of old omit on one ones only onto opaque operator option or order org organization original "
     "other others otherwise output overall page pages paint parallel parentheses part particular parties "
     "passage passages pdf peer permanently permission permit permitted person persons philosophical pixels "
     "place placed plain plus png political portion position possesses postscript preamble preceding precisely "
     "present preserve preserves prevail previous previously principal principally printed prior problems "
     "processing processors produced profit program programs prominent proprietary protocols provide provided "
     "provides providing provisionally proxy prudent public publicity publicly publish published publisher "
     "publishers publishes purpose purposes put qualify quantity read readable readers reading reasonable "
     "reasonably receipt received recommend redistribute redistributing reference refers regarding regardless "
     "regards reinstated related relationship release released releasing relicensing remain remains replace "
     "replaced replacing represented reproduced republish requested require required requirement requires "
     "requiring respects responsible rest resulting retailers retitle review revised revising revisions rights "
     "role royalty rules s sa same san satisfy saying says secondarily secondary section sections see sense "
     "sentence separate server set sgml share short should shown similar simple single site situation so "
     "software some somewhere special specific specification specified specifies specify spirit standard "
     "stands state stated statement statements states stating steps storage straightforwardly subject "
     "sublicense subsequent subsequently substance substantial subunit such suit suitable take technical "
     "terminate terminated terminates termination terms texinfo text textbook texts textual than that the "
     "their them themselves then there therein these they things this those three through thus thwart time "
     "title titles to together tone too tools translated translates translation translations transparent "
     "treated two typically unaltered under unique unless unlimited unmodified until up updated use used "
     "useful users using variety various verbatim version versions violation visible void volume voluminous "
     "warranties warranty was way we web well were what whatsoever when whether which while who whoever whole "
     "whose wide widely wiki will with within without word words work works world written www xcf xml xyz year "
     "years you your zero"),
    ("gpl-1.0",
     "0 02110 1 10 1301 1989 19xx 19yy 2 3 4 5 51 6 69 7 8 9 a above absence absolutely acceptance accompany "
     "achieve act add address addressed advised aggregation agreed agreement agreements all allowed alone "
     "along also alter alternative an and announcement another any anyone appendix applicable applies apply "
     "appropriate appropriately april are arising as ask assemblers assume at attach attempt author authors "
     "automatically away b based be because been being below best boston brief bring but by c called can carry "
     "cause certain change changed changing charge choose clicks code comes commands commit companies "
     "compilers complete compliance concerns conditions consequential conspicuously contact containing "
     "contains contrast convey coon copies copy copying copyright copyrighted correction corresponding cost "
     "could course d damages data date decision defective definitions deny derivative derivatives designed "
     "detail details develop differ different direct disclaimer disclaims display distinguishing distribute "
     "distributed distributing distribution do document does each effectively either electronic else employer "
     "end entire even event ever everyone example except exception exceptions exchange exclusion executable "
     "exercise expressed expressly extent failure february fee fifth file files fitness floor follow following "
     "for forbid form found foundation franklin free freedom from full further general generally get give "
     "given gives gnomovision gnu goals grant granted gratis greatest guarantee guided hacker has have header "
     "here hereby herein holder holders hope how however humanity hypothetical idea if implied impose in "
     "inability inaccurate inc incidental include including incorporate independent indicate information "
     "intact intended interactive interactively interest into introduced is it items its james keep kind know "
     "later law least legal liable libraries license licensed licensee licenses licensor like limited line "
     "long loss losses ma machine mail make making may means medium menu merchantability mercy mere mode "
     "modification modifications modified modify modifying modules more most mouse must name names necessary "
     "need new no nominal noncommercial normally not notice notices number object obtained of offer on one "
     "only operate operating option or original other others otherwise our ours out output paper paragraph "
     "paragraphs part particular parties parts party passed passes performance permission permitted physical "
     "pieces placed pointer portion possibility possible preamble precise preferred present preserving "
     "president price print problems program programmer programs prominent promoting protect protection prove "
     "provide provided public publish published purpose quality readable reads receive received receives "
     "recipient recipients redistribute refer referring refers reflect remain rendered repair reputations "
     "required responsibilities restrictions reuse revised rights risk run running runs s safest sample saying "
     "school scope see sell servicing share sharing short should show sign signature similar simplest so "
     "software some someone something sometimes source speak special specifically specifies specify spirit st "
     "standard start started starts stated stating status steps storage street subject sublicense such suits "
     "sure surrender sustained system tell telling terminate terminated terms than that the their them there "
     "thereof these they things third this those three time to too transfer transferring translate try two ty "
     "type under understands unless usa use useful user users using usual valid verbatim version versions vice "
     "view void volume w want warranties warranty way we welcome what whatever when where whether which who "
     "whole whose will wish with without work write writing written years you your yoyodyne"),
    ("gpl-2.0",
     "0 02110 1 10 11 12 1301 1989 1991 2 3 4 5 51 6 69 7 8 9 a above absence absolutely accept acceptance "
     "access accompanies accompany accord achieve act actions activities add addition address addressed "
     "advised aggregation agreed agreement all allegation allowed along also alter alternative among an and "
     "announcement another any anyone anything applicable application applications applies apply appropriate "
     "appropriately april are arising as ask associated assume at attach attempt author authors automatically "
     "avoid away b balance based be because been being believed below best binary body boston both brief bring "
     "but by c called can cannot carry case cause certain change changed changing charge choice choose "
     "circumstance circumstances claim claims clear clicks code collective comes commands commit compelled "
     "compilation compiler compilers complete compliance component components concerns conditions consequence "
     "consequential consider considered consistent conspicuously constantly constitute contact containing "
     "contains contents contest contradict contrast contributions control convey coon copies copy copying "
     "copyright copyrighted correction corresponding cost could countries counts course court covered "
     "customarily damages danger data date decide decision defective definition deny depends derivative "
     "derivatives derived designated designed detail details develop differ different directly disclaimer "
     "disclaims display distinguishing distribute distributed distributing distribution do document does donor "
     "each effect effectively either electronic else employer end enforcing entire entirely equivalent even "
     "event ever every everyone example except exception exceptions exchange excluded excluding exclusion "
     "excuse executable exercise explicit expressed expressly extend extent failure fee fifth file files "
     "finally fitness floor follow following for forbid form forming found foundation franklin free freedom "
     "from full further general generally generous geographical get give given gives gnomovision gnu goals "
     "granted grants gratis greatest guarantee guided hacker has have having he held here hereby herein "
     "hereinafter holder holders hope how however hypothetical idea identifiable if implemented implied impose "
     "imposed in inability inaccurate inc incidental include included including incorporate incorporates "
     "incorporating independent indicate indirectly individually induce information infringe infringement "
     "installation instead intact integrity intended intent interactive interactively interchange interest "
     "interface interfaces into introduced invalid is issues it items its itself james judgment june keep "
     "kernel kind know language later law least legal lesser liable library license licensed licensee "
     "licensees licenses licensor like limitation limited line linking long loss losses ma machine made mail "
     "major make makes making many may means medium meet menu merchantability mere mode modification "
     "modifications modified modify modifying modules more most mouse must name names necessary need new no "
     "noncommercial normally not nothing notice notices number object obligations obtain of offer offering on "
     "one only operate operating option or order ordinary original other others otherwise our ours out output "
     "outside paper part particular parties parts party passed passes patent patents people performance "
     "performing permission permissions permit permitted pertinent physical physically pieces place placed "
     "places plus pointer portion possibility possible practices preamble precise preferred present preserving "
     "president prevent price print problems program programmer programs prohibited prominent promoting "
     "property proprietary protect protecting protection prove provide provided public publish published "
     "purpose quality range rather readable reads reason reasonably receive received receives recipient "
     "recipients redistribute redistribution redistributors refer referring refers reflect refrain regardless "
     "reliance remain rendered repair reputations required requirements responsibilities responsible rest "
     "restricted restrictions reuse revised right rights risk royalty run running runs s safest same sample "
     "satisfy say saying school scope scripts section sections see separate service servicing share sharing "
     "she short should show sign signature signed similar simultaneously since so software sole some someone "
     "something sometimes source speak special specifies specify spirit start started starts stated stating "
     "status steps storage street subject sublicense subroutine subsection such suits sure surrender sustained "
     "system take telling term terminate terminated terms than that the their them themselves then there "
     "therefore thereof these they things third this thoroughly those though threatened three through thus "
     "time to too transferring translate translated translation true two ty type under understands "
     "unenforceable unless up usa use used useful user users using valid validity verbatim version versions "
     "vice view void volume w want warranties warranty way we welcome what whatever when where whether which "
     "who whole whose wide will willing wish with without work works would write writing written wrote year "
     "years you your yoyodyne"),
    ("gpl-3.0",
     "0 1 10 11 12 13 14 15 16 17 1996 2 20 2007 28 29 3 30 4 5 6 60 6b 6d 7 8 9 a ability about above absence "
     "absolute absolutely abuse accept acceptance access accessible accompanied accompanies accord according "
     "achieve acknowledges acquired across actions activities activity actual actually adapt add added "
     "additional address addressed adopted adversely advised affects affero affirmed affirms after against "
     "aggregate agree agreed agreement aim all alleging allow allowed along already also alternative although "
     "among an ancillary and anti any anyone anything applicable applications applied applies apply "
     "appropriate appropriately approximates are area arise arising arrange arrangement article as asking "
     "assert assets associated assume assumption assumptions assures at attach attempt attributed attributions "
     "author authorization authorized authorizes authorizing authors automatic automatically available avoid "
     "away b based basic be because been behalf being believe below benefit best between beyond body both box "
     "brief business but by c called can cannot carry case cases cause cease certain cessation change changed "
     "changing characterized charge choose choosing circumstances circumvention civil claim claims class clear "
     "clearly closely code collect combination combine combined comes commands commercial commitment common "
     "communication compilation compilations compiler compliance comply component computer computers "
     "concerning concerns conditioned conditions connection consequence consequential consider considered "
     "consistent conspicuously constantly constitutes construed consumer contact contain containing contains "
     "content contents context continue continued contractual contradict contrast contributor control "
     "controlled convenient convey conveyance conveyed conveying conveys copies copy copying copyleft "
     "copyright copyrightable copyrighted correction corresponding cost could counterclaim countries country "
     "course court courts covenant coverage covered criterion cross cure customarily customer d damages danger "
     "data date days december decide declining deemed defective defenses defined definition definitions denied "
     "denominated deny denying deprive designated designed detail details determining develop developers "
     "development devices differ different differently direction directions directly disclaim disclaimer "
     "disclaiming discriminatory display displayed displays distinguishing distribute distributed distributing "
     "distribution do document documented does domains doubtful downstream durable dwelling dynamically e each "
     "earlier effect effected effective effectively efforts either electronic embodied employer enable enables "
     "end enforce enforcing ensure entered entire entirely entity equivalent erroneously essential even event "
     "ever every everyone exact example except exceptions excluded excluding exclusion exclusive exclusively "
     "excuse executable execute executing exercise exercising expected expects explains explicitly express "
     "expressed expressly extend extended extensions extent f facilities fails failure fair family fashion "
     "favor feature fee file files finally find first fitness fixed flow follow following for forbid force "
     "form format forms found foundation free freedom freedoms from fsf fulfilling full functioning "
     "fundamentally further future general generally generate get give given gives giving gnu governed gpl "
     "grant granted grants gratis greatest guarantee gui had has have having hereafter holder holders hope "
     "hosts household how however html https hypothetical idea identifiable if implement implementation "
     "implied import importing impose imposed in inability inaccurate inc incidental include included includes "
     "including inclusion incompatible incorporating incorporation indemnification independent indicate "
     "indicating individual individuals industrial inform information infringe infringed infringement initiate "
     "inside install installation installed instead intact intended intention interaction interactive "
     "interchange interest interface interfaces interfered interpretation interpreter intimate into invalidate "
     "irrevocable is it item its itself june keep kernel key keys kind kinds know knowingly knowledge language "
     "larger later law laws lawsuit least legal lesser lgpl liability liable libraries library license "
     "licensed licensee licensees licenses licensing licensors like likewise limit limitation limited limiting "
     "line link linked linking list litigation local long loss losses machine made mail maintain major make "
     "makes making manner manufacturer march marked marks masks material materially may meaning means measure "
     "measures medium meet meets menu merchantability mere merging met methods might misrepresentation mode "
     "model modification modifications modified modifies modify modifying more moreover most must name names "
     "nature necessary need needed neither network new next no non noncommercially nor normal normally not "
     "nothing notice notices notifies notify notwithstanding number numbered object obligate obligated "
     "obligations occasionally occurring occurs of offer offered offering official on one only operate "
     "operated operating operation option options or order org organization organizations origin original "
     "other others otherwise our out output outside own owned packaged packaging paper paragraph paragraphs "
     "part particular parties parts party pass password patent patents pattern payment peer peers performance "
     "performing permanently permission permissions permissive permit permits permitted perpetuity personal "
     "pertinent physical physically pieces place please plus pointer portion possesses possession possibility "
     "possible power practical practice preamble precise precisely predecessor preferred present presents "
     "preservation prevent prevented previous price primarily prior private problems procedures procuring "
     "produce product products program programmer programming programs prohibit prohibiting prohibits "
     "prominent prominently propagate propagating propagation property proprietary protect protecting "
     "protection protocols prove provide provided provision provisionally proxy public publicity publicly "
     "publish published purpose purposes pursuant qualify quality read readable readily reading ready reason "
     "reasonable receipt receive received receives receiving recipient recipients recognized redistribute "
     "referring refers refrain regard regardless regenerate reinstated relationship released relevant "
     "relicensing relying remain remains removal remove render rendered repair represent require required "
     "requirement requirements requires requiring resolved respect responsibilities responsible restrict "
     "restricting restriction restrictions result resulting results retains return reviewing revised right "
     "rights risk rom royalty rules run running runs s safest sake sale same satisfy saying school scope "
     "scripts secondarily section sections see sell selling semiconductor separable separate separately server "
     "serves service servicing shall share shared short should show sign significant similar simultaneously "
     "single so software sold sole solely some source spare speak special specific specifically specified "
     "specifies specify spirit stand standard standards start starts state stated statement states stating "
     "status steps storage subdividing subject sublicenses sublicensing subprograms subroutine subsection "
     "substantial substantially such sue suffice supplement support supports sure surrender survive sustained "
     "system systematic take tangible technological tells term terminal terminate terminated terminates "
     "termination terms than that the their them then there therefore these they things third this those "
     "though threatened three through thus time to too tools trade trademark trademarks transaction transfer "
     "transferred transferring transmission treated treaty two type typical unacceptable under unless "
     "unlimited unmodified unnecessary unpacking until updates use used useful user users uses using valid "
     "verbatim version versions view violates violation visible void volume w waive waiver want warranties "
     "warranty was way ways we welcome well were what whatever when where whether which who whole whom whose "
     "why widely will window wipo wish with within without work working works worldwide would writing written "
     "www year years you your yourself"),
    ("isc",
     "above action all an and any appear arising as author be c connection consequential contract copies copy "
     "copyright damages data direct disclaims distribute event fee fitness for from granted hereby implied in "
     "including indirect is isc liable license loss merchantability modify negligence no notice of or other "
     "out performance permission profits provided purpose regard resulting shall software special that the "
     "this to tortious use warranties whatsoever whether with without"),
    ("lgpl-2.0",
     "0 02110 1 10 11 12 13 1301 14 15 16 1990 1991 2 2d 3 4 5 51 6 6a 7 8 9 a able above absence accept "
     "acceptance access accessors accompanies accompany accompanying achieve achieved act actions activities "
     "actual add adding addition address addressed advised after aggregation agreed agreement all allegation "
     "allowed along already also alter alternatively among an analogous and another any anyone anything "
     "appeared applicable application applies apply appropriate appropriately april are argument arising as "
     "ask associated assume at attach attempt attention author authorized authors automatically avoid away b "
     "balance based be because been being believed below benefit better between binary blur blurred body "
     "boston both brief bring but by c called can cannot carry case cause certain change changed changes "
     "changing charge choice choose circumstance circumstances claim claims clear close code collection "
     "collective combined companies compelled compilation compile compiled compiler complete compliance "
     "component components compute concerns concluded conditions consequence consequential considered "
     "consistent conspicuously constantly constitute contact containing contains contents contest contradict "
     "contradiction contradicts contrast contributions control conveniently convey coon copies copy copying "
     "copyright copyrighted correction corresponding cost could countries court covered creates customarily "
     "customer d damages danger data date debugging decide decision defective defined definition definitions "
     "deny depends deprive derivative derivatives derived designated designed detail details develop "
     "developers development did differ difference different directing directly disclaimer disclaims displays "
     "distinction distinguishing distribute distributed distributing distribution distributor do document does "
     "don donor during each effect effectively effort either electronic else employer end enforcing "
     "engineering ensure entire entirely equivalent especially even event ever every everyone example except "
     "exception exceptions exchange excluded excluding exclusion excuse executable executables execution "
     "exercise explaining explicit expressed expressly extend extent facilities facility fact failure faith "
     "fall falls faster fee fifth file files finally find first fitness floor follow following for forbid form "
     "former forming found foundation franklin free freedom frob from full function functions further gave "
     "general generally generous geographical get give given gives gnu goals goes good gpl granted grants "
     "gratis greatest guarantee guided hacker happen has have he header held here hereby herein hereinafter "
     "holder holders hope how however idea identifiable if implemented implied impose imposed in inability "
     "inaccurate inc incidental include included including incompatible incorporate incorporated incorporates "
     "independent indicate indirectly individually induce information infringe infringement inline "
     "installation instead intact integrity intended intent interchange interest interface interfaces into "
     "introduced invalid invoked irreversible is isolation issues it its itself james judgment june keep "
     "kernel kind knobs know language later latter law layouts lead least legal legally length less liable "
     "libraries library license licensed licensee licensees licenses licensor limitation limited line lines "
     "link linked linking long loss losses ma machine macros made mail major make making many material "
     "materials may meaningful means medium meet merchantability mere method might modification modifications "
     "modified modify modifying modules more most must name names necessarily necessary need needed new newer "
     "no non normally not note nothing notice notices number numbered numerical object obligations obtain of "
     "offer offering on once one only operate operates operating opt option optional or order ordinary "
     "original other others otherwise our out output outside own paper parameters part particular parties "
     "parts party passed patent patents pay people performance performing performs permission permissions "
     "permit permitted permitting pertinent physical pieces place placed places plus pointer portion portions "
     "possibility possible practices preamble precise precisely preferred prepared present preserving "
     "president prevent price problems produce program programmer programs prohibited prominent promote "
     "promoting property proprietary protect protecting protection prove provide provided public publish "
     "published purpose quality quite random range rather read readable reason reasonably receive received "
     "receives recipient recipients recommend recompile recompiling redistribute redistribution refer "
     "reference referring refers reflect refrain regardless regards released reliance relink remain remains "
     "rendered repair reproducing reputations required requirement requirements requires responsibilities "
     "responsible rest restricted restrictions reuse reverse revised right rights risk root roots royalty "
     "running runs s safest same sample satisfies satisfy say saying school scope scripts section sections see "
     "seen sense sent separate service servicing share sharing she should show side sign signature signed "
     "significant similar simply simultaneously since single small so software sole some someone sometimes "
     "source speak special specially specified specifies specify spirit square start stated states stating "
     "status steps still storage straightforwardly street structure subject sublicense subsection subsequent "
     "such supplied supply sure surrender sustained system t table take ten term terminate terminated terms "
     "textual than that the their them themselves then there therefore these they things third this thoroughly "
     "those though threatened three threshold through thus time to together too tool transferring transforming "
     "translate translated translation treats true tweaking two ty uncombined under understands understood "
     "unenforceable unless unrestricted up usa use used useful user users uses using usually utility valid "
     "validity verbatim verify version versions vice void volume want warranties warranty was way we weaker "
     "well were what whatever when where whether which while who whole whose wide will willing wish with "
     "without work works would write writing written wrote year years you your yoyodyne"),
    ("lgpl-2.1",
     "0 02110 1 10 11 12 13 1301 14 15 16 1990 1991 1999 2 2.1 2d 3 4 5 51 6 6a 7 8 9 a able about above "
     "absence accept acceptance access accessors accompanies accompany accompanying achieve act actions "
     "activities add addition address addressed advantage advantages advised affected after aggregation agreed "
     "agreement all allegation allowed along already also alter alternatively although among an and another "
     "any anything appeared applicable application applies apply appropriate appropriately april are argument "
     "arising as ask associated assume at attach attempt attention author authorized authors automatically "
     "away b balance based be because becomes been being believed below better between binary body boston both "
     "brief bring but by c call called can cannot carefully carry case cases cause certain change changed "
     "changes changing charge choice choose circumstance circumstances claim claims clear close code "
     "collection collective combination combine combined company compatible compelled competing compilation "
     "compiled compiler complete compliance component components compute computer concerns conditions "
     "consequence consequential considered consistent conspicuously constant constitute contact containing "
     "contains contents contest contradict contradiction contradicts contrast contributions control "
     "conveniently convey coon copies copy copying copyright copyrighted correction corresponding cost could "
     "countries counts court covered creates criteria customarily customer d damages data date de debugging "
     "decide decision defective defined definition definitions deny depends derivative derivatives derived "
     "designated designed detail details develop developers differ difference different directing directly "
     "disadvantages disclaimer disclaims displays distinguishing distribute distributed distributing "
     "distribution distributor distributors do document does donor during e each effectively effort either "
     "electronic else employer enables encourage end enforcing engineering ensure entire entirely equivalent "
     "especially even event ever every everyone example except exception exceptions exchange excluded "
     "excluding exclusion excuse executable executables execution exercise existence explaining explanations "
     "explicit expressed expressly extend extent facilities facility fact facto failure faith fall falls "
     "february fee fifth file files finally find first fitness fits floor follow following for forbid form "
     "former forming found foundation franklin free freedom frequent frob from full function functions further "
     "gain gave general generally generous geographical get give given gives gnu goals good gpl granted grants "
     "gratis greater greatest guarantee guided hacker happen has have he header held hence here hereby herein "
     "hereinafter holder holders hope how however idea identifiable if implemented implied impose imposed in "
     "inability inaccurate inc incidental include included including incompatible incorporate incorporates "
     "independent indicate indirectly induce information informed infringe infringement inline insist "
     "installation installs instead intact integrity intended intent interchange interest interface interfaces "
     "into introduced invalid invoked irreversible is isolation issues it its itself james job judgment keep "
     "kernel kind knobs know language large later latter law lax layouts least legal legally length less "
     "lesser liable libraries library license licensed licensee licensees licenses licensor limitation limited "
     "limiting line lines link linked linking linux little long loss losses ma machine macros made mail major "
     "make making many material materials may meaningful means mechanism medium meet merchantability mere "
     "method might modification modifications modified modify modifying modules more most must name names "
     "necessarily necessary need needed new newer no non normally not nothing notice notices number numerical "
     "object obligations obtained obtaining occasions of offer offering on once one only operate operates "
     "operating opt option optional or order ordinary original other others otherwise our out output outside "
     "over own packages paper parameters part particular parties parts party passed patent patents pay people "
     "performance performing performs permission permissions permit permits permitted permitting pertinent "
     "physical pieces place placed places plus pointer portion portions pose possibility possible practices "
     "preamble precise precisely preferred prepared present preserving president price problems produce "
     "program programmer programs prohibited prominent promoting properly property proprietary protect "
     "protecting protection protective prove provide provided provides public publish published purpose "
     "quality quite random range rare rather readable reason reasonably receive received receives recipient "
     "recipients recommend recompile recompiling redistribute redistribution refer reference referring refers "
     "refrain regardless released reliance relink remain remains rendered repair reproducing reputation "
     "required requirement requirements requires responsibilities responsible rest restrict restricted "
     "restrictions restrictive reuse reverse revised right rights risk root roots royalty run running runs s "
     "safest same sample satisfies satisfy say saying school scope scripts section sections see sent separate "
     "service servicing share shared sharing she should show side sign signature signed significant similar "
     "simultaneously since single small so software sole some someone sometimes source speak speaking special "
     "specially specified specifies specify spirit square standard start stated states statically stating "
     "status step still storage straightforwardly strategy street structure subject sublicense subsection "
     "subsequent successor such suggest suitable supplied supply sure surrender sustained system table take "
     "ten term terminate terminated terms than that the their them themselves then there therefore these they "
     "things think third this thoroughly those though threat three threshold through thus time to together too "
     "tool transferring translate translated translation true tweaking two ty typically uncombined under "
     "understood unenforceable unless unrestricted up usa use used useful user users uses using utility valid "
     "validity variant verbatim verify version versions very vice void volume want warranties warranty was way "
     "we well were what whatever when where whereas wherewithal whether which who whole whose wide widely "
     "widest will willing wish with without work works would write writing written wrote year years you your "
     "yoyodyne"),
    ("lgpl-3.0",
     "0 1 2 2007 29 3 4 4d0 4d1 5 6 a acceptance accessors accompany accompanying additional address allowed "
     "already also among an and any applicable application applications applies apply are argument as at "
     "authorization b based be being below both bound but by c called can certain changing choice choose class "
     "code combined combining compatible computer concerns conditions considered contained convey conveyed "
     "conveying copies copy copyright corresponding covered d data debugging decide deemed defined defining "
     "definitions detail differ directing displays distinguishing distribute do document does during e each "
     "effectively effort either engineering ensure event ever everyone exception excluding execute execution "
     "explaining extent facilities facility faith fewer file files find following for form foundation free "
     "from fsf function functions future general give given gnu good governed gpl have header herein https if "
     "in inc include including incorporate incorporated incorporates incorporating information inline install "
     "installation interface invoked is isolation it its june later layouts length lesser libraries library "
     "license limited lines linked linking listed macros made make makes manner material may meaningful means "
     "mechanism minimal mode modification modifications modified modify must necessary needed new none not "
     "notice notices number numbered numerical object of on one only operate operates option or org other "
     "otherwise parameters part particular passed performs permanent permissions permit permitted place "
     "portions present problems produce produced programs prominent properly provide provided proxy public "
     "publish published purpose received recombine recombining reference refers relink relinking remains "
     "reproducing required restrict reverse revised run s same section sections shall shared side similar "
     "single small software source specified specifies specify spirit statement still structure subclass such "
     "suitable supplemented supplied supply system taken templates ten terms than that the then these this "
     "time to together uncombined under use used user uses using utility verbatim version versions was well "
     "whatever when where whether which will with without work works would you your"),
    ("mit",
     "a above action all an and any arising as associated authors be but c charge claim conditions connection "
     "contract copies copy copyright damages deal dealings distribute do documentation event express files "
     "fitness following for free from furnished granted hereby holders implied in included including is kind "
     "liability liable license limitation limited merchantability merge mit modify no noninfringement not "
     "notice obtaining of or other otherwise out particular permission permit person persons portions provided "
     "publish purpose restriction rights sell shall so software subject sublicense substantial the this to "
     "tort use warranties warranty whether whom with without"),
    ("mpl-1.1",
     "1 1.0.1 1.1 1.10 1.10.1 1.11 1.12 1.2 1.3 1.4 1.5 1.6 1.7 1.8 1.8.1 1.9 10 11 12 12.212 13 1995 2 2.1 "
     "2.101 2.2 227.7202 3 3.1 3.2 3.3 3.4 3.5 3.6 3.7 30 4 48 5 50 6 6.1 6.2 6.3 60 7 8 8.1 8.2 8.3 8.4 9 a "
     "able above absence absolutely accepted account acquire acquired action actions add addition additional "
     "admission affect after against agree agreeable agreed agreement agreements all alleging allow alone "
     "already also alter alternative alternatively alters always america amount an and another any anyone api "
     "apis apparatus appear applicable application applies apply appropriate archival archiving are arising "
     "arrangement as assert asserting associated assume at attached attempt attorneys authorized automatically "
     "availability available aware b basis be became becoming been behalf believes beneficial between beyond "
     "breach business by c calculated california can case cause caused change changes character charge "
     "chartered choice choose circumstances citizen claim claims clara clear code collateral combination "
     "combines combining commercial common communications community comparisons compilation complete "
     "compliance comply complying compressed computer concerning conflict confusingly consequential consistent "
     "consisting conspicuously constitute constitutes construed contact contain containing contains contents "
     "continue contract contracts contribute contributes contributor contributors control controlled controls "
     "convention conveyed copies copy copyright corporation correction cost costs county court courts covered "
     "create created creates creation cure d damages data date day days de death decision declatory "
     "decompression deemed defective defects defined definition definitions delete deleted deleting deletion "
     "derivative derived describe described describes description designate detail detailed determining "
     "developer development device devices differ different differential differs direct direction directly "
     "directory disclaimer disclosed display dispose disputes distinguishing distribute distributed "
     "distributes distribution distributions distributor distributors district do document documentation "
     "documenting does drafter due duplicate each effect effective either electronic end enforceable ensuring "
     "entire entities entity equitable essential even event every except excluded excluding exclusion "
     "exclusive executable exercise exercising exhibit expenses expiration express expressed expressly extent "
     "f fail failure federal fee fees fifty file files filling first fit for form forth found free from "
     "fulfilled future generally given goods goodwill governed governing government grant granted grantor "
     "grants had hardware has have having held hereafter hereby herein hereof hereunder how however https i "
     "identified if ii implement implied impose impossible in inability incidental include included includes "
     "including incurred indemnify indemnity indicate indirect indirectly individual inform information "
     "informed infringed infringement infringements infringes infringing initial initially initiate initiation "
     "injury installation instead intellectual intended interface international into is issued it item its "
     "judgment judicial june jurisdiction jurisdictions kind know knowledge known language larger law least "
     "legal liability liable licensable license licensed licenses likely limit limitation limitations lists "
     "litigation location look losing loss losses lying made mailing maintained make makes making malfunction "
     "management matter matters maximum may means mechanism media merchantable met method miscellaneous "
     "modification modifications modified modify modules months more mozilla mozillapl mozpl mpl multiple must "
     "mutually name nations nature necessary negligence netscape new newsgroups no non northern not note "
     "nothing notice notices notifying notwithstanding now npl number obligation obligations obtain obtained "
     "obtains oct of offer offered offering on once one only or order ordinary org origin original other "
     "others otherwise out outstanding own owned ownership part participant particular parties party past "
     "patent patents pay payment percent perform performance period permits person personal phrase phrases "
     "plus portions possibility possible power practice preferred previous prior process product programming "
     "prohibited prohibits prominent promptly properly property prospectively prove provided provides "
     "provision provisions public publish published purpose purposes pursuant put quality r rather reasonable "
     "reasonably receipt received recipient recipients referred reformed registered regulation related "
     "relating release released relevant remain remains rename repair replace representations represents "
     "reproduce required requirements resellers reserved resolved respect responsibility responsible restricts "
     "result resulting revised revoked right rights risk royalty s sale same santa scripts section sections "
     "see sell selling separate sept series servicing set settlement shall shares should similar single six "
     "skill slightly so software sold some source special specific specified statement states stating statute "
     "steps stoppage structure subject sublicense sublicenses subsequent subsequently substance such "
     "sufficient sufficiently supplier support sure survive take taken term terminate termination terms text "
     "than that the their them themselves then theory thereafter thereof they third this those through time "
     "titled to tort trademark transfer twelve u under understand unenforceable united unless unmodified upon "
     "use used user users using utilization utilize validly value venue version versions via warranties "
     "warranty well when where whether which who whom wide widely will wish with withdraw withdrawn within "
     "without work works world would writing www you your"),
    ("mpl-2.0",
     "1 1.1 1.10 1.11 1.12 1.13 1.14 1.2 1.3 1.4 1.5 1.6 1.7 1.8 1.9 10 10.1 10.2 10.3 10.4 2 2.0 2.1 2.2 2.3 "
     "2.4 2.5 2.6 2.7 3 3.0 3.1 3.2 3.3 3.4 3.5 30 4 5 5.1 5.2 5.3 50 6 60 7 8 9 a ability able above absence "
     "absolutely accurate actions add addition additional additionally affect affero after against agree "
     "agreement agreements all alleging allow alone also alter an and any anyone apparatus applicable "
     "application apply are as asserting assume at attached attempt authorized automatically available b back "
     "basis be become been behalf believes beneficial bring brought business but by c can case cause caused "
     "character charge choice choose circumstances claim claims clear code combination combines come "
     "commercial common complete compliance compliant comply computer concerning conditions conflict "
     "consequential constitutes construe construed contained contains contents contract contribute contributes "
     "contribution contributions contributor contributors control controlled controls conveyed copy copyright "
     "correction cost counter courts covered create creates creation cross damages date days dealing death "
     "declaratory defective defects defendant defined definition definitions deletion describe described "
     "description desirable detailed different differs direct direction directly directory disclaimer "
     "disclaimers display distinguishing distribute distributed distributes distributing distribution "
     "distributions distributors do doctrines document does drafter due each earlier effect effective either "
     "end enforceable entire entities entity equivalents essential even event every except excluding exclusion "
     "exclusive executable exercising exhibit explicitly exploit expressed extent factual fail fails failure "
     "fair fee fifty file files finally first fit following for form foundation free from further general "
     "given gnu goodwill governed grant granted grants has have having held hereby hereof how however http i "
     "if ii implied import impossible in inability inaccuracies incidental include included includes including "
     "incompatible incurred indemnify indemnity indirect indirectly individual inform informed infringed "
     "infringement infringements infringes infringing initial initiate injury intellectual intended into is it "
     "its judgment judicial jurisdiction jurisdictions kind known language larger later law laws legal lesser "
     "liability liable licensable license licenses licensing likely limit limitation limitations litigation "
     "location logos look loss losses lost made maintains make makes making malfunction management manner "
     "marks material matter maximum may means merchantable method miscellaneous modification modifications "
     "modified modify more moreover mozilla mpl must name necessary negligence new no non not note nothing "
     "notice notices notifies notify notwithstanding number obligation obligations obtain of offer offered "
     "offering on one ongoing only option or order ordinary org original originally other others otherwise "
     "outstanding own ownership owns part particular party patent percent perform performance permits "
     "permitted personal place placed portions possibility possible power preferred prevent principal prior "
     "process profits prohibited prohibits property prove provided provides provision provisionally provisions "
     "public publish published purpose purposes put quality reasonable receipt received recipient recipients "
     "reference references reformed regulation reinstated relating relevant remedy remove removed rename "
     "repair representation represents reproduce required requirements resellers respect responsibilities "
     "restrict result resulting results right rights risk royalty s sale scope secondary section sections see "
     "sell selling separate service servicing shall shares should skill so software some source special "
     "specific statute statutory steward stoppage subject sublicense subsequent subsequently substance such "
     "sufficient sufficiently support survive terminate terminates termination terms text than that the their "
     "then theory thereof they third this those time timely to tort trademark trademarks transfer under "
     "understand unenforceable unless unmodified until use used user using v validly version versions want "
     "warranties warranty was where whether which who wide will with within without work world would you your"),
]
